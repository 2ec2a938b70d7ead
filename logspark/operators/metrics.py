"""Confusion counts, precision / recall / F1 and precision-recall curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.operators.rank import running_totals


def _counts(predicted: Column, actual: Column) -> list[Column]:
    pairs = {"tn": (0, 0), "fp": (1, 0), "fn": (0, 1), "tp": (1, 1)}
    return [F.count_if((predicted == p) & (actual == a)).alias(name) for name, (p, a) in pairs.items()]


def confusion_matrix(
    scores: DataFrame, threshold: float = 0.5, prob: str = "prob", y: str = "y", by: list[str] | None = None,
) -> DataFrame:
    """``tn, fp, fn, tp``; a score counts as 1 strictly above the threshold."""
    return scores.groupBy(*(by or [])).agg(*_counts(C.above(F.col(prob), threshold), F.col(y)))


def confusion_of(flags: DataFrame, predicted: str = "pred", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """The same from 0 / 1 predictions."""
    return flags.groupBy(*(by or [])).agg(*_counts(F.col(predicted), F.col(y)))


def prf(confusion: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and F1; 0.0 where there is nothing to divide by."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p, r = F.col("precision"), F.col("recall")
    return (
        confusion
        .withColumn("accuracy", (tp + tn).cast("double") / F.greatest(tp + tn + fp + fn, F.lit(1)))
        .withColumn("precision", C.safe_ratio(tp, tp + fp))
        .withColumn("recall", C.safe_ratio(tp, tp + fn))
        .withColumn("f1", C.safe_ratio(2 * p * r, p + r))
    )


def prf_metrics(scores: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    return prf(confusion_matrix(scores, threshold, by=by))


def batch_weighted_accuracy(scores: DataFrame, batch: str = "batch", threshold: float = 0.5) -> DataFrame:
    """Accuracy per batch, averaged with the batch sizes as weights."""
    hit = (C.above(F.col("prob"), threshold) == F.col("y")).cast("double")
    per_batch = scores.groupBy(batch).agg(F.avg(hit).alias("acc"), F.count(F.lit(1)).alias("n"))
    return per_batch.agg(
        (F.coalesce(F.sum(F.col("acc") * F.col("n")), F.lit(0.0))
         / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("accuracy"))


def class_summary(rows: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Instances, anomalies and normals, in total and per split; rows without a split keep a null there."""
    return (
        rows.rollup(split).agg(
            F.grouping(split).alias("_all"),
            F.count(F.lit(1)).alias("instances"),
            F.count_if(F.col(label) == 1).alias("anomaly"),
            F.count_if(F.col(label) != 1).alias("normal"))
        .withColumn(split, F.when(F.col("_all") == 1, "total").otherwise(F.col(split)))
        .drop("_all")
    )


def accuracy_from_totals(totals: DataFrame) -> DataFrame:
    """``normal, abnormal, fp, fn`` -> ``tn, tp, accuracy``."""
    return (
        totals.withColumn("tn", F.col("normal") - F.col("fp"))
        .withColumn("tp", F.col("abnormal") - F.col("fn"))
        .withColumn("accuracy", C.safe_ratio(F.col("tp") + F.col("tn"), F.col("normal") + F.col("abnormal")))
    )


def union_batches(batches: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, batches)


def rank_by_score(scores: DataFrame, key: str = "id") -> DataFrame:
    """Descending score, ties by id."""
    return scores.orderBy(F.desc("prob"), key)


def best_epoch(results: DataFrame, epoch: str = "epoch", accuracy: str = "accuracy") -> DataFrame:
    """The earliest row among those with the highest accuracy."""
    return results.orderBy(F.desc(accuracy), epoch).limit(1)


# ---- curves -------------------------------------------------------------------------------------

def cumulative_tp_fp(scores: DataFrame, key: str = "id") -> DataFrame:
    """Running true and false positives by descending score; every row is its own point."""
    return running_totals(
        scores.select(key, "prob", "y"), [F.desc_nulls_last("prob"), F.col(key)],
        sums={"tp": (F.col("y") == 1).cast("bigint"), "fp": (F.col("y") == 0).cast("bigint")})


def pr_points(scores: DataFrame, key: str = "id") -> DataFrame:
    """``key, prob, y, rank, tp, fp, positives, precision, recall`` at every rank."""
    points = cumulative_tp_fp(scores, key).withColumnRenamed("total_tp", "positives").drop("total", "total_fp")
    return (
        points
        .withColumn("precision", F.col("tp").cast("double") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)))
        .withColumn("recall", C.safe_ratio(F.col("tp"), F.col("positives")))
    )


def areas(points: DataFrame) -> DataFrame:
    """``n, positives, pr_auc`` (trapezoids) and ``average_precision``, one row.

    Recall only moves at positive rows, by 1 / positives, so both are sums over those rows and the
    point before one follows from its own counts: no look-back window is needed.
    """
    hit = F.col("y") == 1
    before = F.when(F.col("rank") == 1, F.lit(1.0)).otherwise(
        (F.col("tp") - 1).cast("double") / F.greatest(F.col("tp") - 1 + F.col("fp"), F.lit(1)))
    step = F.lit(1.0) / F.col("positives")
    return points.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max("positives"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(F.when(hit, step * (F.col("precision") + before) / 2)), F.lit(0.0)).alias("pr_auc"),
        F.coalesce(F.sum(F.when(hit, step * F.col("precision"))), F.lit(0.0)).alias("average_precision"),
    )


def pr_end_points(points: DataFrame) -> DataFrame:
    """``rank, recall, precision`` of the two end points of a curve, from one pass over its points."""
    ends = points.agg(
        F.count(F.lit(1)).alias("n"), F.max("positives").alias("positives"),
        F.max_by("precision", "rank").alias("last"),
    ).where(F.col("n") > 0)
    some = F.col("positives") > 0
    return ends.select(F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("rank"), F.lit(0.0).alias("recall"),
                 F.when(some, 1.0).otherwise(0.0).alias("precision")),
        F.struct((F.col("n") + 1).alias("rank"), F.lit(1.0).alias("recall"),
                 F.when(some, F.col("last")).otherwise(0.0).alias("precision")),
    )).alias("p")).select("p.*")


def pr_curve(scores: DataFrame, key: str = "id") -> DataFrame:
    """``rank, recall, precision`` with the end points (0, 1) and (1, last precision).

    Without positives the curve is (0, 0), (1, 0); without rows it is empty.
    """
    points = pr_points(scores, key)
    body = points.where(F.col("positives") > 0).select("rank", "recall", "precision")
    return body.unionByName(pr_end_points(points))


def pr_summary(scores: DataFrame, key: str = "id") -> DataFrame:
    """Rows, positives and both areas; 0 rows or 0 positives give areas 0."""
    return areas(pr_points(scores, key))
