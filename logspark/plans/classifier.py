"""Encoded traces -> trained sequence classifier -> test metrics and curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.detectors import sequence
from logspark.functions import columns as C
from logspark.operators import metrics, split
from logspark.session import configure, sized
from logspark.sources import datasets, sinks


def fixed_traces(rows: DataFrame, length: int) -> DataFrame:
    """``block_id, tokens, y``: the last ``length`` events + 1, zeros in front, and a 0 / 1 label.

    A very long session lies in several segments; its tail is in the last ones, of which no more
    than ``length`` can matter since a segment has at least one event.
    """
    shifted = rows.withColumn("_t", C.shift_tokens(F.transform("x_data", C.event_token)))
    if "segment" not in rows.columns:
        tokens = C.pad_truncate(F.col("_t"), length)
        return shifted.select("block_id", tokens.alias("tokens"), C.binarise_label(F.col("y_data")).alias("y"))
    last = W.partitionBy("block_id").orderBy(F.desc("segment"))
    tails = (
        shifted.select("block_id", "segment", "y_data", C.pad_truncate(F.col("_t"), length).alias("_t"))
        .withColumn("_place", F.row_number().over(last)).where(F.col("_place") <= length)
    )
    whole = F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("segment", "_t"))), lambda s: F.filter(s["_t"], lambda t: t > 0)))
    return tails.groupBy("block_id").agg(
        C.pad_truncate(whole, length).alias("tokens"), C.binarise_label(F.max("y_data")).alias("y"))


def train_classifier(
    spark: SparkSession, traces_path: str, out: str, length: int = 64, max_traces: int | None = None,
    seed: int = 42, val_frac: float = 0.1, test_frac: float = 0.1, threshold: float = 0.5,
    regs: tuple[float, ...] = (0.1, 0.01, 0.001),
) -> DataFrame:
    """Metrics per setting and split; the best model and its test curve are written below ``out``.

    ``max_traces`` takes that many sessions, drawn by a hash of the key, for all three parts; by default all are used.
    """
    configure(spark)
    rows = datasets.load_traces(spark, traces_path)
    if max_traces is not None:
        # The key decides the order, so the segments of a session stay together.
        kept = split.cap_traces(rows.select("block_id").distinct(), "block_id", max_traces, seed)
        rows = rows.join(sized(kept), "block_id", "left_semi")
    traces = fixed_traces(rows, length)
    results, scores = sequence.select_model(
        traces, "block_id", f"{out}/model", regs, val_frac, test_frac, seed, threshold, length)
    scores = scores.withColumnRenamed("block_id", "id")
    sinks.write_pr_curve(metrics.pr_curve(scores), metrics.pr_summary(scores), f"{out}/curve")
    return results
