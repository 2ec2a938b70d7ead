"""Exact top-k search by inner product with a vector-approximation file.

Every vector is kept twice: exactly, and as a small approximation, the number of its cell per component (a quarter of a byte
to a byte each). A query scans the approximations only: a cell's borders bound the inner product from below and above.
The k-th largest lower bound is a floor that the answer can't fall under, so what has a lower upper bound is
out. Of what is left, exact vectors are read in the order of their upper bounds: first the k most promising of each query;
their k-th exact score raises the floor, and only vectors whose upper bound still reaches it are read
after. Then the k-th result is certain; nothing is approximate in the result.

Equal vectors are one entry with their k + 1 smallest ids, so a vector that a third of all rows share is looked
at once. Queries go in blocks of a bounded number of different vectors, each block sent to all tasks; the vectors
themselves never move in the scan. Cell borders are even steps between the smallest and largest component of
each dimension over all rows.

Cases: vectors null, empty or holding null or non-finite components take no part, nor do rows without vec_id; a repeated row
counts once; a vec_id with several vectors is no neighbour of itself; vectors of another length than
the query are no neighbours; ties go to the smaller vec_id; fewer candidates than k give all; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.session import written

K = 5
SCALE = 256
BITS = 5
#: Different query vectors sent around at once; some ten MB at a thousand components.
QUERIES_AT_ONCE = 4_096
#: Rows of the approximation looked at together: rows x queries numbers of 8 bytes.
CELLS_AT_ONCE = 2_000_000


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding.cast("array<double>"), lambda x: F.floor(x * scale))


def usable(embedding: Column) -> Column:
    good = F.forall(embedding.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & good


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, vec): different vectors, each with its k + 1 smallest ids; ``rep`` is the smallest.

    The window keeps k + 1 rows of a vector per task before anything is shuffled.
    """
    place = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    few = rows.distinct().withColumn("_place", place).where(F.col("_place") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("rep"), "ids", "vec")


def borders(vectors: DataFrame, bits: int) -> np.ndarray:
    """Cell borders (component, cell), even steps over all rows; one row per component comes to the driver."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            block = _matrix(batch.column(0))
            if not len(block):
                continue
            low = block.min(0) if low is None else np.minimum(low, block.min(0))
            high = block.max(0) if high is None else np.maximum(high, block.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)],
                                             ["at", "low", "high"])

    rows = vectors.select("vec").mapInArrow(ends, "at bigint, low bigint, high bigint").groupBy("at").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()
    low, high = (np.array([row[name] for row in rows]) for name in ("low", "high"))
    steps = np.arange((1 << bits) + 1) / (1 << bits)
    edges = np.ceil(low[:, None] + (high - low + 1)[:, None] * steps)
    return edges.astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0), np.int64)
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def approximated(vectors: DataFrame, edges: np.ndarray) -> DataFrame:
    """(rep, cells): the number of each component's cell, one byte each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = _matrix(batch.column(1))
            cells = np.empty(block.shape, np.uint8)
            for n in range(block.shape[1]):
                cells[:, n] = np.searchsorted(edges[n], block[:, n], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([row.tobytes() for row in cells], pa.binary())], ["rep", "cells"])

    return vectors.select("rep", "vec").mapInArrow(run, "rep bigint, cells binary")


def _bounds(cells: np.ndarray, edges: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest inner product (row, query) of vectors in ``cells``."""
    at = np.arange(cells.shape[1])
    low, high = edges[at, cells].astype(float), edges[at, cells + 1].astype(float) - 1
    up, down = np.maximum(queries, 0.0).T, np.minimum(queries, 0.0).T
    return low @ up + high @ down, high @ up + low @ down


def _blocks(batches: Iterator[pa.RecordBatch], width: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        reps = np.asarray(batch.column(0))
        cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(reps), width)
        for start in range(0, len(reps), at_once):
            yield reps[start:start + at_once], cells[start:start + at_once]


def _search_block(approx: DataFrame, exact: DataFrame, edges: np.ndarray, reps: list[int], queries: np.ndarray, k: int) -> DataFrame:
    """(query, rep, score): the k + 1 best entries for each of ``queries`` by score, then rep."""
    spark = approx.sparkSession
    sent = spark.sparkContext.broadcast((edges, queries.astype(float)))
    size = max(1, CELLS_AT_ONCE // max(1, len(queries)))
    want = k + 1

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_edges, own = sent.value
        best = np.full((0, len(own)), -np.inf)
        for _, cells in _blocks(batches, len(own_edges), size):
            best = np.concatenate([best, _bounds(cells, own_edges, own)[0]])
            if len(best) > want:
                best = np.partition(best, len(best) - want, 0)[-want:]
        if len(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(len(own)), len(best))), pa.array(best.ravel())], ["query", "low"])

    # k + 1 rows per task and query, and again k + 1 per task before the shuffle.
    lows = approx.mapInArrow(floors, "query bigint, low double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("low")))
    kept = lows.withColumn("_place", place).where(F.col("_place") <= want).groupBy("query").agg(
        F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).collect()
    floor = np.full(len(queries), -np.inf)
    for row in kept:
        if row["n"] == want:
            floor[row["query"]] = row["low"]
    floor_sent = spark.sparkContext.broadcast(floor)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_edges, own = sent.value
        for own_reps, cells in _blocks(batches, len(own_edges), size):
            high = _bounds(cells, own_edges, own)[1]
            row, query = np.nonzero(high >= floor_sent.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query), pa.array(own_reps[row]), pa.array(high[row, query])], ["query", "rep", "high"])

    left = written(approx.mapInArrow(candidates, "query bigint, rep bigint, high double"), "candidates")
    first = F.row_number().over(W.partitionBy("query").orderBy(F.desc("high"), "rep"))
    opening = written(_exact(left.withColumn("_place", first).where(F.col("_place") <= want).drop("_place"),
                             exact, spark, queries), "opening")
    certain = opening.groupBy("query").agg(F.min("score").alias("_floor"), F.count(F.lit(1)).alias("_n"))
    rest = (
        left.join(opening.select("query", "rep"), ["query", "rep"], "left_anti")
        .join(F.broadcast(certain), "query")  # a row per query of the block
        .where((F.col("_n") < want) | (F.col("high") >= F.col("_floor"))).select("query", "rep", "high"))
    every = opening.unionByName(_exact(rest, exact, spark, queries))
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep"))
    names = spark.sparkContext.broadcast(reps)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(names.value, np.int64)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[np.asarray(batch.column(0))]), batch.column(1), batch.column(2)], ["query", "rep", "score"])

    top = every.withColumn("_place", best).where(F.col("_place") <= want).select("query", "rep", "score")
    return top.mapInArrow(named, "query bigint, rep bigint, score bigint")


def _exact(pairs: DataFrame, exact: DataFrame, spark, queries: np.ndarray) -> DataFrame:
    """(query, rep, score) with the exact inner product."""
    sent = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query = np.asarray(batch.column(0))
            block = _matrix(batch.column(2))
            score = np.einsum("ij,ij->i", block, sent.value[query]) if len(query) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.int64())], ["query", "rep", "score"])

    return pairs.select("query", "rep").join(exact.select("rep", "vec"), "rep").select("query", "rep", "vec").mapInArrow(
        run, "query bigint, rep bigint, score bigint")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``queries`` against all rows of ``vectors``, both (vec_id, vec)."""
    result = None
    asked = written(queries.distinct(), "queries")
    held = written(vectors, "vectors")
    for row in asked.select(F.size("vec").alias("n")).distinct().orderBy("n").collect():
        own = held.where(F.size("vec") == row["n"])
        part = _search_length(own, asked.where(F.size("vec") == row["n"]), k, bits, at_once)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias(
            "score")).limit(0)
    return result


def _search_length(vectors: DataFrame, queries: DataFrame, k: int, bits: int, at_once: int) -> DataFrame:
    exact = written(entries(vectors, k), "exact")
    edges = borders(exact, bits)
    if not len(edges):
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast(
            "bigint").alias("score")).limit(0)
    approx = written(approximated(exact, edges), "cells")
    # Each different query vector once, by the smallest query id that has it.
    different = written(queries.groupBy("vec").agg(F.min("vec_id").alias("rep")), "asked")
    blocks = -(-different.count() // at_once)
    block_of = F.pmod(F.xxhash64("rep"), F.lit(max(blocks, 1)))
    found = None
    for n in range(blocks):
        rows = different.where(block_of == n).orderBy("rep").collect()
        if rows:
            part = _search_block(approx, exact, edges, [r["rep"] for r in rows], np.array([r["vec"] for r in rows]), k)
            part = written(part, "found")
            found = part if found is None else found.unionByName(part)
    own = queries.join(different.withColumnRenamed("rep", "_group"), "vec").select(F.col("vec_id").alias("query_id"), "_group")
    named = own.join(found, own["_group"] == found["query"]).join(exact.select("rep", "ids"), "rep").select(
        "query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    best = named.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def prepared(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    return table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", scaled(F.col("embedding"), scale).alias("vec"))
