"""Connected components of a graph that no task and no driver ever holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); ``root`` is the smallest node of the component.

    Large-star and small-star rounds: each hangs a node's neighbours under the smallest one it knows, which
    halves the depth and never adds edges. A hub only sends its minimum along a join that Spark may
    split, and minima combine before the shuffle. Every round is a table in the shared folder.
    """
    current = written(_ordered(edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    before = None
    while (now := _digest(current)) != before:
        before = now
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(lowest, "a").where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("_m").alias("b"))
        large = written(_ordered(large), "edges")
        lowest = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(lowest, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")),
        )).alias("_e")).select("_e.*")
        current = written(_ordered(small), "edges")
    # All edges now lead to roots.
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(
        F.concat_ws(":", "a", "b")))).first())
