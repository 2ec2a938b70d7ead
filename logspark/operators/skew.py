"""Sessions of any length: short ones are one group, longer ones are cut into segments.

One session may hold a third of all rows. Its events cannot be one array or one window partition,
so it is cut into segments of ``max_events`` events: consecutive, disjoint, together the whole
session. Sessions up to that length are never cut, so the usual result is one row per session.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.operators.rank import running_totals
from logspark.session import sized

ORDER = ["line_id", "pos"]


@dataclass(frozen=True)
class Limits:
    """``max_events``: longest uncut session, some ten MB of events in one task.
    ``max_keys``: most long-session keys sent to all tasks.
    """

    max_events: int = 100_000
    max_keys: int = 100_000


DEFAULT = Limits()


def split_long(
    events: DataFrame, key: str, limits: Limits = DEFAULT,
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``events`` of sessions up to the limit, those of longer sessions, and the keys of these.

    The last two are None when no session is that long. Counting needs the key column only and
    combines before its shuffle. The keys found are few (rows / max_events); they are sent to all
    tasks up to ``max_keys`` and joined normally beyond.
    """
    long_keys = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > limits.max_events).select(key)
    if long_keys.isEmpty():
        return events, None, None
    keys = sized(long_keys, limits.max_keys)
    return events.join(keys, key, "left_anti"), events.join(keys, key, "left_semi"), keys


def cut_segments(long_events: DataFrame, key: str, order: list[str], max_events: int, halo: int = 0) -> DataFrame:
    """Add ``segment`` and, for windows, copies of the ``halo`` events before each segment.

    ``is_halo`` marks the copies. ``halo`` must not exceed ``max_events``.
    """
    if halo > max_events:
        raise ValueError("a segment must be at least as long as the look-back")
    ranked = running_totals(long_events, [F.col(c) for c in order], within=[key])
    index = F.col("rank") - 1
    placed = ranked.withColumn("segment", F.floor(index / max_events).cast("bigint"))
    if halo == 0:
        return placed.withColumn("is_halo", F.lit(False)).drop("rank", "total")
    in_tail = (index % max_events >= max_events - halo) & (
        (F.col("segment") + 1) * max_events < F.col("total"))
    copies = F.when(in_tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        placed.withColumn("_shift", F.explode(copies))
        .withColumn("segment", F.col("segment") + F.col("_shift"))
        .withColumn("is_halo", F.col("_shift") == 1)
        .drop("_shift", "rank", "total")
    )


def over_sessions(
    events: DataFrame,
    key: str,
    order: list[str],
    look_back: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    limits: Limits = DEFAULT,
) -> DataFrame:
    """Apply ``build(df, window)``, whose functions look at most ``look_back`` rows back."""
    short, long_events, _ = split_long(events, key, limits)
    result = build(short, W.partitionBy(key).orderBy(*order))
    if long_events is None:
        return result
    cut = cut_segments(long_events, key, order, limits.max_events, look_back)
    cut_result = build(cut, W.partitionBy(key, "segment").orderBy(*order))
    return result.unionByName(cut_result.where(~F.col("is_halo")).drop("segment", "is_halo"))
