"""Integer codes for events. Code tables are as large as the event vocabulary, never as the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.functions import columns as C
from logspark.session import sized


def event_rank(events: DataFrame, event: str = "event_id") -> DataFrame:
    """``event_id, code``: 1-based, numeric order, observed ids only."""
    seen = events.select(F.col(event).alias("event_id")).distinct()
    order = W.orderBy(C.event_number(F.col("event_id")), "event_id")
    return seen.withColumn("code", F.row_number().over(order).cast("bigint"))


def lexical_rank(events: DataFrame, event: str = "event_id") -> DataFrame:
    """``event_id, code``: 0-based, text order, observed ids only."""
    seen = events.select(F.col(event).alias("event_id")).distinct()
    return seen.withColumn("code", (F.dense_rank().over(W.orderBy("event_id")) - 1).cast("bigint"))


def join_codes(tuples: DataFrame, codes: DataFrame, event: str = "event_id") -> DataFrame:
    """Code per event, 0 for events without one."""
    table = sized(codes.select(F.col("event_id").alias(event), "code"))
    return tuples.join(table, event, "left").withColumn("code", F.coalesce("code", F.lit(0)))


def encoder_transform(tuples: DataFrame, codes: DataFrame, event: str = "event_id") -> DataFrame:
    """Code per event; an event unknown to the encoder is an error."""
    table = sized(codes.select(F.col("event_id").alias(event), "code"))
    unknown = F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce(event, F.lit("null"))))
    return tuples.join(table, event, "left").withColumn("code", F.coalesce("code", unknown.cast("bigint")))


def num_tokens(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """Largest token + 1 over the kept traces; padding counts as token 0."""
    return tokens.agg((F.coalesce(F.max(F.array_max(column)), F.lit(0)) + 1).alias("num_tokens"))
