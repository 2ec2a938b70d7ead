"""The batch functions on a stream: parsing is stateless and scoring joins a stream to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators.parse import structured_lines


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Parsed and matched lines of text files as they arrive in ``path``.

    Dense line numbers need all files; a stream has none.
    """
    lines = spark.readStream.text(path).select(F.make_valid_utf8("value").alias("value"))
    return structured_lines(lines)


def run_to_end(stream: DataFrame, out: str, state: str) -> int:
    """Take what has arrived so far through the stream into a Parquet folder, exactly once.

    ``state`` must stay with ``out``: a restarted query goes on after the last committed batch. Gives the number of rows that came
    too late for a window that was closed already.
    """
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])


def sessions_by_gap(
    events: DataFrame, key: str, gap: str, late: str, ts: str = "ts", **measures: Column,
) -> DataFrame:
    """``key, start, end, events, <measures>``: events of a key less than ``gap`` apart, on a stream or a table.

    Sessions here are ends of activity in time, unlike the traces of the batch flow, which are by file order. On a stream a session
    comes out once, when the newest time seen, less ``late``, has passed its end; rows older than that are left out and
    counted by :func:`run_to_end`. State holds open sessions only, each as its bounds and partial aggregates, so a key
    with very many events costs no more than one with few. Rows without key or time are no part of a session: see
    :func:`untimed`.
    """
    timed = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_at", F.col(ts).cast("timestamp"))
    window = F.session_window("_at", gap)
    found = timed.withWatermark("_at", late).groupBy(key, window.alias("_w")).agg(
        F.count(F.lit(1)).alias("events"), *[measure.alias(name) for name, measure in measures.items()])
    return found.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events", *measures)


def untimed(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The rows that :func:`sessions_by_gap` has no place for, for a table of their own."""
    return events.where(F.col(key).isNull() | F.col(ts).isNull())


def unexpected_pairs(pairs: DataFrame, followers: DataFrame) -> DataFrame:
    """Pairs of a stream that the next-event model does not expect (stream - static anti join)."""
    return pairs.join(followers, ["context", "next"], "left_anti")
