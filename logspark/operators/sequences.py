"""Windows over the events of a session: tails, lags and contexts, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.functions import columns as C
from logspark.operators.rank import running_totals
from logspark.operators.skew import DEFAULT, Limits, over_sessions


#: Longest tail that Spark's own limit per task and key is used for, by default.
TASK_LIMIT = 1_000


def last_n_events(events: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The trailing ``n`` events of each session, with ``from_end`` 1 for the last one.

    Spark keeps at most ``n`` rows per key and task before the shuffle, so long sessions are cheap. It does so up to
    ``TASK_LIMIT`` rows; a longer tail is cut from distributed ranks, where a session of any length is spread over many tasks.
    """
    if n > TASK_LIMIT:
        ranked = running_totals(events, [F.desc(c) for c in order], within=[key])
        return ranked.where(F.col("rank") <= n).withColumn("from_end", F.col("rank").cast("int")).select(*events.columns, "from_end")
    last = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("from_end", F.row_number().over(last)).where(F.col("from_end") <= n)


def padded_tokens(events: DataFrame, key: str, order: list[str], token: str, length: int) -> DataFrame:
    """``key, tokens``: the last ``length`` tokens of each session, zeros in front.

    Only the tail is collected, so array size does not depend on session length.
    """
    tail = last_n_events(events, key, order, length)
    tokens = F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("from_end")).alias("p"), F.col(token).cast("bigint").alias("t")))),
        lambda e: e.t)
    return tail.groupBy(key).agg(C.pad_truncate(tokens, length).alias("tokens"))


def dilated_lags(
    events: DataFrame, key: str, order: list[str], token: str,
    kernel: int = 3, levels: int = 3, limits: Limits = DEFAULT,
) -> DataFrame:
    """The inputs a causal filter with dilation 1, 2, 4, ... sees at each position; 0 before the start."""
    lags = sorted({j * 2**level for level in range(levels) for j in range(1, kernel)})

    def build(df: DataFrame, window) -> DataFrame:
        return df.select("*", *[
            F.coalesce(F.lag(token, lag).over(window), F.lit(0)).alias(f"lag_{lag}") for lag in lags])

    return over_sessions(events, key, order, max(lags), build, limits)


def next_event_pairs(
    events: DataFrame, key: str, order: list[str], event: str, history: int, limits: Limits = DEFAULT,
) -> DataFrame:
    """``key, order.., context, next``: each event with the ``history`` events before it.

    The first events of a session have no full context and give no pair.
    """
    def build(df: DataFrame, window) -> DataFrame:
        before = [F.lag(event, lag).over(window).alias(f"_b{lag}") for lag in range(history, 0, -1)]
        keep = [c for c in ("segment", "is_halo") if c in df.columns]
        return (
            df.select(key, *order, *keep, F.col(event).alias("next"), *before)
            .where(F.col(f"_b{history}").isNotNull())
            .withColumn("context", F.concat_ws(" ", *[f"_b{lag}" for lag in range(history, 0, -1)]))
            .drop(*[f"_b{lag}" for lag in range(1, history + 1)])
        )

    return over_sessions(events.where(F.col(event).isNotNull()), key, order, history, build, limits)
