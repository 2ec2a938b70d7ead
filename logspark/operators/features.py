"""Per-session counts and times. All combine before their shuffle, so a hot session is no problem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.operators.encode import event_rank


def error_counts(tuples: DataFrame) -> DataFrame:
    """Error events per session, null when there are none."""
    return tuples.groupBy("block_id").agg(
        F.nullif(F.count_if(C.is_error_event(F.col("event_id"))), F.lit(0)).alias("type"))


def latencies(tuples: DataFrame) -> DataFrame:
    """Last minus first known time in file order, 0 below two known times.

    All rows of a line share its time, so the line number alone gives the order, and the aggregate
    keeps to plain numbers that Spark updates in place.
    """
    place = F.when(F.col("ts").isNotNull(), F.col("line_id"))
    span = C.seconds(F.max_by("ts", place)) - C.seconds(F.min_by("ts", place))
    return tuples.groupBy("block_id").agg(
        F.when(F.count("ts") >= 2, C.round_latency(span)).otherwise(F.lit(0).cast("bigint")).alias("latency"))


def event_counts(tuples: DataFrame, key: str = "block_id", event: str = "event_id") -> DataFrame:
    """Sparse occurrence counts, for any number of events."""
    return tuples.groupBy(key, event).agg(F.count(F.lit(1)).alias("n"))


def ordered_events(events: DataFrame, event: str = "event_id") -> DataFrame:
    """Observed ids with their 1-based code, in numeric order."""
    return event_rank(events, event).orderBy("code")


def observed_events(events: DataFrame, event: str = "event_id", limit: int = 10_000) -> list[str]:
    """Observed ids in numeric order. Bounded by the vocabulary, which must stay below ``limit``."""
    rows = (
        events.select(F.col(event).alias("event_id")).distinct()
        .orderBy(C.event_number(F.col("event_id")), "event_id").limit(limit + 1).collect()
    )
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct events: use event_counts, the long form")
    return [row["event_id"] for row in rows]


def occurrence_matrix(
    tuples: DataFrame, events: list[str], key: str = "block_id", event: str = "event_id",
) -> DataFrame:
    """One int column per event, also for events no session holds.

    One conditional count per column: a single shuffle with partial sums, where ``pivot`` takes two.
    """
    return tuples.groupBy(key).agg(
        *[F.count_if(F.col(event) == e).cast("int").alias(e) for e in events])


def unpivot_matrix(matrix: DataFrame, events: list[str], key: str = "block_id") -> DataFrame:
    """Back to the long form, zero counts left out."""
    return matrix.unpivot(key, events, "event_id", "n").where(F.col("n") > 0)
