"""Ranks and running sums over a whole table without one task seeing it all.

A window without partition keys, or with one hot partition key, puts everything in one task. Here the rows are
shuffled once, by range of the full sort key, so equal leading values still spread. Each task adds running counts and sums to
its sorted range and writes them; the ranges' totals, one row each, then give what lies before each range. Ranks
inside groups are the global ranks less those of the group's first row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from logspark.session import sized, written

#: Rows of a range, so that the number of tasks grows with the rows.
ROWS_PER_RANGE = 200_000


def running_totals(
    df: DataFrame,
    order_by: list[Column],
    within: list[str] | None = None,
    sums: dict[str, Column] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``rank`` (1-based, dense by row), ``total`` rows of the group, running ``sums`` of whole numbers that
    aren't negative, and their group totals as ``total_<name>``.

    ``order_by`` must be unique inside ``within`` for a repeatable result. Give it few columns: they are written twice.
    """
    within, sums = within or [], sums or {}
    columns = df.columns
    narrow = written(df.withColumns({f"_s_{name}": F.coalesce(e.cast("bigint"), F.lit(0)) for name, e in sums.items()}), "rows")
    if ranges is None:
        ranges = max(1, -(-narrow.count() // ROWS_PER_RANGE))
    key = [F.col(c) for c in within] + order_by
    sorted_ = narrow.repartitionByRange(ranges, *key).sortWithinPartitions(*key)
    names = list(sums)
    added = ["_range", "_at", *[f"_c_{name}" for name in names]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, before = TaskContext.get().partitionId(), 0, dict.fromkeys(names, 0)
        for batch in batches:
            rows = batch.num_rows
            extra = [pa.repeat(pa.scalar(part, pa.int64()), rows), pa.array(range(seen + 1, seen + rows + 1), pa.int64())]
            seen += rows
            for name in names:
                column = pc.add(pc.cumulative_sum(batch.column(f"_s_{name}")), before[name])
                if rows:
                    before[name] = column[-1].as_py()
                extra.append(column)
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *added])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in narrow.schema],
                           *[T.StructField(name, T.LongType()) for name in added]])
    placed = written(sorted_.mapInArrow(count, schema), "ranked")
    upto = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(
        F.max("_at").alias("_at"), *[F.max(f"_c_{name}").alias(f"_c_{name}") for name in sums]).select(
        "_range", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_before{c}") for c in added[1:]])
    # One row per range.
    known = placed.join(F.broadcast(offsets), "_range").select(
        *columns, *[f"_s_{name}" for name in sums],
        *[(F.col(c) + F.col(f"_before{c}")).alias(c) for c in added[1:]])
    groups = known.groupBy(*within).agg(
        F.count(F.lit(1)).alias("total"), (F.min("_at") - 1).alias("_first"),
        *[F.min(F.col(f"_c_{n}") - F.col(f"_s_{n}")).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_s_{n}").alias(f"total_{n}") for n in sums])
    groups = sized(groups) if within else F.broadcast(groups)
    match = F.lit(True)
    for name in within:  # null group keys are groups too
        match = match & F.col(f"_l.{name}").eqNullSafe(F.col(f"_r.{name}"))
    return known.alias("_l").join(groups.alias("_r"), match).select(
        *[F.col(f"_l.{c}") for c in columns],
        (F.col("_at") - F.col("_first")).alias("rank"),
        "total",
        *[(F.col(f"_c_{n}") - F.col(f"_b_{n}")).alias(n) for n in sums],
        *[f"total_{n}" for n in sums],
    )
