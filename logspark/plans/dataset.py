"""Raw log and labels -> the five dataset outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import catalog
from logspark.functions import columns as C
from logspark.operators import encode, features, parse, sessions
from logspark.operators.skew import DEFAULT, Limits
from logspark.session import configure
from logspark.sources import datasets, logs, sinks


def narrow_events(events: DataFrame) -> DataFrame:
    """Event, time and keys of every line. Only unmatched lines need their own display text."""
    own_text = F.when(F.col("event_id") == catalog.UNMATCHED_EVENT, F.col("event_template"))
    return events.select(
        "line_id", "event_id", "ts", own_text.alias("own_text"), C.blocks_all(F.col("content")).alias("keys"))


def write_events(events: DataFrame, path: str) -> DataFrame:
    """The one pass over the text, as a narrow table.

    Everything later reads this table, and only the columns it needs: the regexes run once, and a
    lost executor costs a re-read.
    """
    narrow_events(events).write.mode("errorifexists").parquet(path)
    return events.sparkSession.read.parquet(path)


def tuples_of(table: DataFrame) -> DataFrame:
    return table.select(
        "line_id", "event_id", "ts", F.posexplode("keys").alias("pos", "block_id")).select("block_id", *sessions.EVENT)


def stats_of(table: DataFrame) -> DataFrame:
    return parse.template_stats(table.withColumn(
        "event_template", C.template_text(F.col("event_id"), F.col("own_text"))))


def encoded_sequences(tuples: DataFrame, labels: DataFrame, codes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """``block_id, segment, x_data, y_data``: 1-based codes of the observed events, label 0 by default.

    Codes are joined before events are gathered, so any number of different events will do.
    """
    coded = encode.join_codes(tuples, codes).withColumn("event_id", F.col("code").cast("int"))
    built = sessions.labelled_sessions(coded, labels, limits)
    return built.select("block_id", "segment", F.transform("events", lambda e: e.event_id).alias("x_data"),
                        F.col("label").cast("bigint").alias("y_data"))


def build_dataset(
    spark: SparkSession, log_path: str, out: str, label_path: str | None = None, limits: Limits = DEFAULT,
) -> DataFrame:
    """Write templates, traces, matrix, sequences and labels below ``out``; give the run's counters."""
    configure(spark)
    table = write_events(parse.structured_lines(logs.number_lines(spark, log_path)), f"{out}/events")
    tuples, labels = tuples_of(table), datasets.load_labels(spark, label_path)
    events = features.observed_events(table)

    sinks.write_templates(stats_of(table), f"{out}/templates")
    sinks.write_traces(sessions.trace_features(tuples, labels, limits=limits), f"{out}/traces")
    sinks.write_matrix(features.occurrence_matrix(tuples, events), events, f"{out}/matrix")
    sinks.write_sequences(encoded_sequences(tuples, labels, encode.event_rank(table), limits), f"{out}/sequences")
    keys = tuples.select("block_id").distinct()
    sinks.write_labels(sessions.label_sessions(keys, labels), f"{out}/labels")
    return parse.parse_summary(table, tuples, labels)
