"""Events -> sessions (traces), in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.operators.skew import DEFAULT, ORDER, Limits, cut_segments, over_sessions, split_long
from logspark.session import sized

EVENT = ["line_id", "pos", "event_id", "ts"]


def session_tuples(events: DataFrame) -> DataFrame:
    """One row per (line, key in its text); a key named twice gives two rows, a keyless line none."""
    return events.select(
        "line_id", "event_id", "ts",
        F.posexplode(C.blocks_all(F.col("content"))).alias("pos", "block_id"),
    ).select("block_id", *EVENT)


def first_block_tuples(events: DataFrame) -> DataFrame:
    """One row per line with a key, under its first key; lines without one are dropped."""
    keep = [c for c in ("line_id", "event_id", "ts") if c in events.columns]
    return events.select(C.block_first(F.col("content")).alias("block_id"), *keep).where(
        F.col("block_id").isNotNull())


def _ordered(fields: list[str]) -> Column:
    return F.sort_array(F.collect_list(F.struct(*fields)))


def build_sessions(tuples: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """``block_id, segment, events`` with events in file order; segment is 0 unless very long."""
    short, cut, _ = _session_parts(tuples, limits)
    return short if cut is None else short.unionByName(cut)


def _session_parts(tuples: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Whole sessions, segments of long ones, and the keys of these."""
    short, long_events, keys = split_long(tuples, "block_id", limits)
    whole = short.groupBy("block_id").agg(_ordered(EVENT).alias("events")).select(
        "block_id", F.lit(0).cast("bigint").alias("segment"), "events")
    if long_events is None:
        return whole, None, None
    cut = cut_segments(long_events, "block_id", ORDER, limits.max_events)
    return whole, cut.groupBy("block_id", "segment").agg(_ordered(EVENT).alias("events")), keys


def label_sessions(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join with default 0, for one row per session.

    No hint: the size of ``labels`` decides at run time.
    """
    return sessions.join(labels.select("block_id", "label"), "block_id", "left").withColumn(
        "label", F.coalesce("label", F.lit(0)))


def label_segments(segments: DataFrame, keys: DataFrame, labels: DataFrame) -> DataFrame:
    """The same for many rows per session: only the labels of the few long ones are sent around.

    A join on the session key would bring all segments of a session into one task.
    """
    few = sized(label_sessions(keys, labels))
    return segments.join(few, "block_id")


def labelled_sessions(tuples: DataFrame, labels: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """:func:`build_sessions` with a label."""
    short, cut, keys = _session_parts(tuples, limits)
    whole = label_sessions(short, labels)
    return whole if cut is None else whole.unionByName(label_segments(cut, keys, labels))


def event_gaps(tuples: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Seconds since the previous event of the session, 0.0 when either time is missing.

    One row per event but the first of each session.
    """
    def build(df: DataFrame, window) -> DataFrame:
        now, before = C.seconds(F.col("ts")), F.lag(C.seconds(F.col("ts"))).over(window)
        return (
            df.withColumn("_first", F.lag("line_id").over(window).isNull())
            .withColumn("gap", F.coalesce(C.round_gap(now - before), F.lit(0.0)))
        )

    return over_sessions(tuples, "block_id", ORDER, 1, build, limits).where(~F.col("_first")).drop("_first")


def trace_features(tuples: DataFrame, labels: DataFrame, errors=None, limits: Limits = DEFAULT) -> DataFrame:
    """One typed row per session: label, error count, event text, gap text, latency.

    The plan is one shuffle on the session key. Sessions beyond ``limits`` give one row per
    ``segment``: texts are those of the segment; the session's error count and latency stand in its first
    row only, so that sums over rows are sums over sessions.
    """
    error = C.is_error_event(F.col("event_id"), errors) if errors is not None else C.is_error_event(F.col("event_id"))
    short, long_events, keys = split_long(tuples, "block_id", limits)

    grouped = short.groupBy("block_id").agg(
        _ordered(EVENT).alias("events"), F.count_if(error).alias("errors"))
    valid = F.filter("events", lambda e: e.ts.isNotNull())
    latency = C.seconds(F.element_at("valid", -1).ts) - C.seconds(F.element_at("valid", 1).ts)
    rows = grouped.withColumn("valid", valid).withColumn("timed", F.size("valid")).select(
        "block_id", F.lit(0).cast("bigint").alias("segment"), "errors",
        F.transform("events", lambda e: e.event_id).alias("event_ids"),
        _gap_texts(F.col("events")).alias("gaps"),
        F.col("timed").cast("bigint").alias("timed"),
        F.when(F.col("timed") >= 2, C.round_latency(latency)).otherwise(0).alias("latency"),
    )
    rows = label_sessions(rows, labels)
    if long_events is not None:
        rows = rows.unionByName(_long_rows(long_events, keys, labels, error, limits))

    text = F.when(F.col("timed") < 2, "[0.0]").otherwise(
        F.concat(F.lit("["), F.array_join("gaps", ", "), F.lit("]")))
    return rows.select(
        "block_id", "segment",
        C.label_text(F.col("label")).alias("label"),
        F.nullif("errors", F.lit(0)).alias("type"),
        C.features_string(F.col("event_ids")).alias("features"),
        text.alias("time_interval"),
        "latency",
    )


def _gap_texts(events: Column) -> Column:
    """Texts of the gaps between neighbours of an ordered event array."""
    pairs = F.arrays_zip(
        F.slice(events, F.lit(1), F.greatest(F.size(events) - 1, F.lit(0))).alias("a"),
        F.slice(events, F.lit(2), F.greatest(F.size(events) - 1, F.lit(0))).alias("b"),
    )
    return F.transform(pairs, lambda p: F.coalesce(
        C.gap_text(C.seconds(p["b"]["ts"]) - C.seconds(p["a"]["ts"])), F.lit("0.0")))


def _long_rows(
    long_events: DataFrame, keys: DataFrame, labels: DataFrame, error: Column, limits: Limits,
) -> DataFrame:
    """One row per segment, with the counts and the label of its session."""
    place = F.when(F.col("ts").isNotNull(), F.col("line_id"))
    first, last = F.min_by("ts", place), F.max_by("ts", place)
    totals = long_events.groupBy("block_id").agg(
        F.count_if(error).alias("errors"), F.count("ts").alias("timed"),
        (C.seconds(last) - C.seconds(first)).alias("span"))
    totals = sized(label_segments(totals, keys, labels))
    cut = cut_segments(long_events, "block_id", ORDER, limits.max_events, halo=1)
    segments = cut.groupBy("block_id", "segment").agg(_ordered([*EVENT, "is_halo"]).alias("events"))
    own = F.filter("events", lambda e: ~e.is_halo)
    first_row = F.col("segment") == 0
    return segments.join(totals, "block_id").select(
        "block_id", "segment", F.when(first_row, F.col("errors")).alias("errors"),
        F.transform(own, lambda e: e.event_id).alias("event_ids"),
        _gap_texts(F.col("events")).alias("gaps"),
        "timed",
        F.when(first_row, F.when(F.col("timed") >= 2, C.round_latency(F.col("span"))).otherwise(0)).alias("latency"),
        "label",
    )
