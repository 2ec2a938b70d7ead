"""Clusters of normal sessions; far from all of them is anomalous (Lin et al., ICSE 2016).

The published method walks through the sessions one by one. Here the order plays no part. Distinct vectors, as directions
(weighted counts of length 1), are put into the cells of a grid; the heaviest vector of each cell leads a
cluster, and what lies within ``max_distance`` of a leader is settled. Cells shrink from round to round for at most
``COARSE`` rounds; in the last round a cell is no wider than ``max_distance``, so its leader settles all of it. The
number of rounds doesn't depend on the data.

Leaders are a table, never an array on the driver, and are searched through a metric index. A bounded number of
them are pivots; each leader belongs to the cell of its nearest pivot, and for each pair of pivot and cell the range of
angles is known. A vector goes to the cell of its nearest pivot first. With the angle found there, all cells that
the triangle inequality rules out are left alone, and the others are visited by a join on the cell, in blocks
of bounded size on both sides, however many vectors or leaders a cell has. The nearest leader found is the exact one.

New normal sessions can be taken in later (:meth:`ClusterDetector.updated`): those near a cluster join it, the others found new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.detectors.vectors import distinct_vectors, idf_weights, score_by_vector
from logspark.session import written

#: Rounds with cells that are wider than a cluster.
COARSE = 5
#: Leaders that come to the driver and go to all tasks; with no more than these there is nothing to join.
PIVOTS = 64
#: Bytes of vectors, of each side, that are compared at once.
BLOCK_BYTES = 16 << 20
#: Distances up to the limit count as near, whatever the rounding; the width of the last cells stays below that.
SLACK = 1e-9
#: More than the arc cosine of a rounded number can be off.
ANGLE_SLACK = 1e-6
#: The distance where there is no cluster at all.
NOWHERE = 3.0

_CENTRES = "cluster bigint, unit array<double>, round int"
_FOUND = "id bigint, cluster bigint, distance double"


def unit_rows(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted vectors of length 1; an all-zero one points along an extra axis of its own."""
    values = np.hstack([counts * idf, np.zeros((len(counts), 1))])
    length = np.linalg.norm(values, axis=1)
    values[length == 0, -1] = 1.0
    return values / np.where(length == 0, 1.0, length)[:, None]


def with_units(rows: DataFrame, columns: list[str], idf: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` and ``unit``, the same as :func:`unit_rows`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
            units = unit_rows(counts, idf)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(list(units), pa.list_(pa.float64()))], [*keep, "unit"])

    kinds = dict(rows.dtypes)
    wanted = list(dict.fromkeys([*keep, *columns]))
    return rows.select(*wanted).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "unit array<double>"]))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _closest(units: np.ndarray, centres: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name of and cosine distance to the closest centre, the smallest name of equals. ``names`` rise."""
    name, distance = np.zeros(len(units), np.int64), np.zeros(len(units))
    for start in range(0, len(units), 1_024):
        part = slice(start, start + 1_024)
        similarity = units[part] @ centres.T
        best = similarity.argmax(axis=1)
        name[part], distance[part] = names[best], 1.0 - similarity[np.arange(len(best)), best]
    return name, distance


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


@dataclass
class CentreIndex:
    """Leaders by the cell of their nearest pivot. ``near`` and ``far`` are ranges of angles (pivot, cell)."""

    pivots: np.ndarray
    names: np.ndarray
    cells: DataFrame | None = None  # (cluster, unit, cell), None when all leaders are pivots
    near: np.ndarray | None = None
    far: np.ndarray | None = None

    @classmethod
    def of(cls, centres: DataFrame, pivots: int = PIVOTS) -> CentreIndex:
        """``centres``: (cluster, unit), a written table."""
        # One row more than are used says whether there are others.
        picked = centres.select("cluster", "unit").orderBy(F.xxhash64("cluster"), "cluster").limit(pivots + 1).collect()
        chosen = sorted(picked[:pivots], key=lambda row: row["cluster"])
        index = cls(np.array([row["unit"] for row in chosen], float), np.array([row["cluster"] for row in chosen], np.int64))
        if len(picked) <= pivots:
            return index
        sent = centres.sparkSession.sparkContext.broadcast(index.pivots)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                angles = _angles(_matrix(batch.column(1)), sent.value) if batch.num_rows else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(angles.argmin(1), pa.int32()), pa.array(list(angles), pa.list_(pa.float64()))],
                    ["cluster", "unit", "cell", "angles"])

        placed = written(centres.select("cluster", "unit").mapInArrow(
            place, "cluster bigint, unit array<double>, cell int, angles array<double>"), "cells")
        # A row per pair of pivots.
        ranges = placed.select("cell", F.posexplode("angles").alias("pivot", "angle")).groupBy("cell", "pivot").agg(
            F.min("angle").alias("near"), F.max("angle").alias("far")).collect()
        index.near, index.far = np.full((pivots, pivots), np.inf), np.full((pivots, pivots), -np.inf)
        for row in ranges:
            index.near[row["pivot"], row["cell"]], index.far[row["pivot"], row["cell"]] = row["near"], row["far"]
        index.cells = placed.select("cluster", "unit", "cell")
        return index

    def may_hold(self, angles: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(row, cell): whether the cell can hold a leader within ``radius`` of the row."""
        open_ = np.ones((len(angles), len(self.names)), bool)
        for pivot in range(len(self.names)):
            at, slack = angles[:, pivot, None], radius[:, None] + ANGLE_SLACK
            open_ &= (at - slack <= self.far[pivot]) & (at + slack >= self.near[pivot])
        return open_

    def nearest(self, rows: DataFrame) -> DataFrame:
        """(id, cluster, distance) of each of ``rows`` (id, unit): the nearest leader of all."""
        if not len(self.names):
            return rows.select("id", F.lit(-1).cast("bigint").alias("cluster"), F.lit(NOWHERE).alias("distance"))
        if self.cells is None:
            return self._among_pivots(rows)
        first = written(self._asks(rows, None), "asks")
        found = written(self._visited(first), "found")
        rest = written(self._asks(first.join(found.select("id", "distance"), "id"), "distance"), "asks")
        both = found.unionByName(self._visited(rest))
        best = F.min(F.struct("distance", "cluster"))
        return both.groupBy("id").agg(best.alias("_best")).select("id", "_best.cluster", "_best.distance")

    def _among_pivots(self, rows: DataFrame) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast((self.pivots, self.names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    name, distance = _closest(_matrix(batch.column(1)), *sent.value)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(name), pa.array(distance)], ["id", "cluster", "distance"])

        return rows.select("id", "unit").mapInArrow(run, _FOUND)

    def _asks(self, rows: DataFrame, known: str | None) -> DataFrame:
        """(id, unit, cell): the cell of the nearest pivot, or with a ``known`` distance the other cells that may hold less."""
        sent = rows.sparkSession.sparkContext.broadcast(CentreIndex(self.pivots, self.names, None, self.near, self.far))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for start in range(0, batch.num_rows, 4_096):
                    part = batch.slice(start, 4_096)
                    angles = _angles(_matrix(part.column(1)), index.pivots)
                    row, cell = np.arange(len(angles)), angles.argmin(1)
                    if known is not None:
                        radius = np.arccos(np.clip(1.0 - np.asarray(part.column(2)), -1.0, 1.0))
                        held = index.may_hold(angles, radius)
                        held[row, cell] = False
                        row, cell = np.nonzero(held)
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column(0), taken.column(1), pa.array(cell, pa.int32())], ["id", "unit", "cell"])

        wanted = ["id", "unit"] if known is None else ["id", "unit", known]
        return rows.select(*wanted).mapInArrow(run, "id bigint, unit array<double>, cell int")

    def _visited(self, asks: DataFrame) -> DataFrame:
        """(id, cluster, distance): the nearest of the cell asked for. Both sides of a cell are cut into blocks by hash."""
        spark = asks.sparkSession
        at_once = max(1, BLOCK_BYTES // (8 * self.pivots.shape[1]))
        sizes = {}
        for n, side in enumerate((asks, self.cells)):  # a row per cell
            for row in side.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
                sizes.setdefault(row["cell"], [1, 1])[n] = -(-row["n"] // at_once)
        blocks = F.broadcast(spark.createDataFrame(
            [(cell, *own) for cell, own in sorted(sizes.items())], "cell int, _asks int, _centres int"))

        def dealt(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
            every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
            return side.join(blocks, "cell").withColumn("_own", F.pmod(F.xxhash64(key), F.col(own)).cast("int")).withColumn(
                "_other", every).withColumnsRenamed({"_own": f"{own}_block", "_other": f"{other}_block"})

        keys = ["cell", "_asks_block", "_centres_block"]
        left = dealt(asks, "id", "_asks", "_centres").select(*keys, "id", "unit").groupBy(*keys)
        right = dealt(self.cells, "cluster", "_centres", "_asks").select(*keys, "cluster", "unit").groupBy(*keys)

        def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
            none = pa.table({"id": pa.array([], pa.int64()), "cluster": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            if not asked.num_rows or not held.num_rows:
                return none
            held = held.sort_by("cluster")
            name, distance = _closest(_matrix(asked.column("unit")), _matrix(held.column("unit")), np.asarray(held.column("cluster")))
            return pa.table({"id": asked.column("id"), "cluster": pa.array(name), "distance": pa.array(distance)})

        best = F.min(F.struct("distance", "cluster"))
        return left.cogroup(right).applyInArrow(compare, _FOUND).groupBy("id").agg(best.alias("_best")).select(
            "id", "_best.cluster", "_best.distance")


@dataclass
class ClusterDetector:
    """``centres``: (cluster, unit, round), a written table. ``offline`` and ``online``: clusters found when fitted, and since."""

    columns: list[str]
    idf: np.ndarray
    centres: DataFrame
    max_distance: float
    offline: int
    online: int
    rounds: int

    def transform(self, matrix: DataFrame) -> DataFrame:
        """Add ``cluster``, ``score`` (distance to it) and ``pred``."""
        return score_by_vector(matrix, self.columns, self.score)

    def score(self, rows: DataFrame) -> DataFrame:
        """The same row by row."""
        if self.index.cells is None:
            scored = self._score_among_pivots(rows)
        else:
            held = written(rows.withColumn("id", F.monotonically_increasing_id()), "scored")
            found = self.index.nearest(with_units(held, self.columns, self.idf, ["id"]))
            scored = held.join(found, "id").select(*rows.columns, "cluster", F.col("distance").alias("score"))
        return scored.withColumn("pred", (F.col("score") > self.max_distance + SLACK).cast("int"))

    @cached_property
    def index(self) -> CentreIndex:
        return CentreIndex.of(self.centres)

    def _score_among_pivots(self, rows: DataFrame) -> DataFrame:
        """Few clusters are in all tasks: nothing is written or joined."""
        columns, sent = self.columns, rows.sparkSession.sparkContext.broadcast((self.idf, self.index.pivots, self.index.names))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            idf, pivots, names = sent.value
            for batch in batches:
                name, distance = np.full(len(batch), -1, np.int64), np.full(len(batch), NOWHERE)
                if len(names):
                    name, distance = _closest(unit_rows(batch[columns].to_numpy(float), idf), pivots, names)
                yield batch.assign(cluster=name, score=distance)

        kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
        return rows.mapInPandas(run, f"{kinds}, cluster bigint, score double")

    def summaries(self, matrix: DataFrame) -> DataFrame:
        """(cluster, unit, sessions, width): the sessions of ``matrix`` nearest to each cluster, and the distance of the farthest."""
        rows = self.score(distinct_vectors(matrix, self.columns))
        held = rows.groupBy("cluster").agg(F.sum("weight").cast("bigint").alias("sessions"), F.max("score").alias("width"))
        return self.centres.select("cluster", "unit").join(held, "cluster", "left").withColumn(
            "sessions", F.coalesce("sessions", F.lit(0)))

    def updated(self, normal: DataFrame) -> ClusterDetector:
        """The detector after more normal sessions: what no cluster holds yet founds new ones. Weights of events stay."""
        last = self.centres.agg(F.max("cluster")).first()[0]
        rows = _directions(distinct_vectors(normal, self.columns), self.columns, self.idf, -1 if last is None else last)
        known = self.index.nearest(rows)
        left = written(rows.join(known.where(F.col("distance") > self.max_distance + SLACK).select("id"), "id", "left_semi"), "left")
        found, rounds = _lead(left, self.max_distance, len(self.columns) + 1)
        return replace(self, centres=written(self.centres.unionByName(found), "centres"), online=self.online + found.count(), rounds=rounds)

    def save(self, path: str) -> None:
        """Replace what is at ``path``; a detector may not be saved over the files it was loaded from."""
        self.centres.write.mode("overwrite").parquet(f"{path}/centres")
        SparkSession.active().createDataFrame(
            [(self.columns, [float(x) for x in self.idf], self.max_distance, self.offline, self.online, self.rounds)],
            _SETTINGS).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> ClusterDetector:
        spark = SparkSession.active()
        kept = spark.read.schema(_SETTINGS).parquet(f"{path}/settings").first()
        return cls(list(kept["columns"]), np.array(kept["idf"]), spark.read.schema(_CENTRES).parquet(f"{path}/centres"),
                   kept["max_distance"], kept["offline"], kept["online"], kept["rounds"])


_SETTINGS = "columns array<string>, idf array<double>, max_distance double, offline int, online int, rounds int"


def _directions(rows: DataFrame, columns: list[str], idf: np.ndarray, after: int) -> DataFrame:
    """(id, unit, weight) of distinct vectors; ids follow ``after``."""
    numbered = rows.withColumn("id", F.monotonically_increasing_id() + F.lit(after + 1))
    return written(with_units(numbered, columns, idf, ["id", "weight"]), "directions")


def _steps(max_distance: float, width: int) -> list[float]:
    """Sides of the cells, round by round; the diagonal of the last is the chord of ``max_distance``."""
    last = float(np.sqrt(2.0 * (max_distance + SLACK / 2)) / np.sqrt(width))
    return [*[s for s in (0.5**n for n in range(COARSE)) if s > last], last]


def _cell(step: float) -> Column:
    return F.transform("unit", lambda x: F.round(x / F.lit(step)).cast("bigint"))


def _lead(rows: DataFrame, max_distance: float, width: int) -> tuple[DataFrame, int]:
    """Leaders (cluster, unit, round) that have all of ``rows`` (id, unit, weight) within ``max_distance``, and the rounds taken."""
    found: list[DataFrame] = []
    left, steps = rows, _steps(max_distance, width)
    for number, step in enumerate(steps, 1):
        if left.isEmpty():
            break
        # The heaviest of the cell, the first of equals. Combined before the shuffle.
        heaviest = F.max_by(F.struct("id", "unit"), F.struct(F.col("weight"), -F.col("id")))
        leaders = written(left.groupBy(_cell(step).alias("_cell")).agg(heaviest.alias("_lead")).select(
            F.col("_lead.id").alias("cluster"), F.col("_lead.unit").alias("unit"), F.lit(number).alias("round")), "leaders")
        found.append(leaders)
        if step != steps[-1]:
            near = CentreIndex.of(leaders).nearest(left)
            far = near.where(F.col("distance") > max_distance + SLACK).select("id")
            left = written(left.join(far, "id", "left_semi"), "left")
    none = rows.sparkSession.createDataFrame([], _CENTRES)
    return reduce(DataFrame.unionByName, found) if found else none, len(found)


def fit_clusters(normal: DataFrame, columns: list[str], max_distance: float = 0.3, weighting: str = "tf-idf") -> ClusterDetector:
    """Fit on normal sessions. A round looks only at the vectors left and the leaders it has just found."""
    rows, idf = distinct_vectors(normal, columns), np.ones(len(columns))
    if weighting == "tf-idf":
        rows = written(rows, "distinct")
        idf = idf_weights(rows, columns)
    centres, rounds = _lead(_directions(rows, columns, idf, -1), max_distance, len(columns) + 1)
    return ClusterDetector(columns, idf, centres, max_distance, centres.count(), 0, rounds)
