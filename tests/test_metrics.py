"""Metrics and curves against numpy, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators import metrics

SCHEMA = "id bigint, prob double, y int"


def curve_by_numpy(prob, y):
    order = np.lexsort((np.arange(len(prob)), -prob))
    hit = y[order] == 1
    tp, fp = np.cumsum(hit), np.cumsum(~hit)
    precision, recall = tp / np.maximum(tp + fp, 1), tp / hit.sum()
    r, p = np.r_[0, recall, 1], np.r_[1, precision, precision[-1]]
    area = float(np.sum(np.diff(r) * (p[1:] + p[:-1]) / 2))
    ap = float(np.sum(np.diff(np.r_[0, recall]) * precision))
    return r, p, area, ap


def test_curve(spark):
    rng = np.random.default_rng(3)
    prob, y = np.round(rng.random(500), 2), (rng.random(500) < 0.2).astype(int)
    scores = spark.createDataFrame([(n, float(p), int(v)) for n, (p, v) in enumerate(zip(prob, y))], SCHEMA)
    r, p, area, ap = curve_by_numpy(prob, y)
    points = metrics.pr_curve(scores).orderBy("rank").collect()
    assert np.allclose([x.recall for x in points], r) and np.allclose([x.precision for x in points], p)
    summary = metrics.pr_summary(scores).first()
    assert np.allclose([summary.pr_auc, summary.average_precision], [area, ap])
    assert (summary.n, summary.positives) == (500, y.sum())


def test_first_row_positive(spark):
    scores = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0)], SCHEMA)
    summary = metrics.pr_summary(scores).first()
    assert (summary.pr_auc, summary.average_precision) == (1.0, 1.0)


def test_no_rows(spark):
    scores = spark.createDataFrame([], SCHEMA)
    assert metrics.pr_curve(scores).count() == 0
    assert tuple(metrics.pr_summary(scores).first()) == (0, 0, 0.0, 0.0)


def test_no_positives(spark):
    scores = spark.createDataFrame([(1, 0.9, 0), (2, 0.8, 0)], SCHEMA)
    points = [(r.recall, r.precision) for r in metrics.pr_curve(scores).orderBy("rank").collect()]
    assert points == [(0.0, 0.0), (1.0, 0.0)]
    assert tuple(metrics.pr_summary(scores).first()) == (2, 0, 0.0, 0.0)


@pytest.mark.parametrize("data, expected", [
    ([], (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)),
    ([(1, 0.5, 1)], (0, 0, 1, 0, 0.0, 0.0, 0.0, 0.0)),
    ([(1, 0.6, 1), (2, 0.6, 0), (3, 0.1, 0), (4, 0.9, 1)], (1, 1, 0, 2, 0.75, 2 / 3, 1.0, 0.8)),
])
def test_prf(spark, data, expected):
    row = metrics.prf_metrics(spark.createDataFrame(data, SCHEMA)).first()
    assert np.allclose([row[c] for c in ("tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1")], expected)


def test_published_totals(spark):
    totals = spark.createDataFrame([(14177, 4123, 1179, 225)], "normal bigint, abnormal bigint, fp bigint, fn bigint")
    row = metrics.accuracy_from_totals(totals).first()
    assert (row.tp, row.tn) == (3898, 12998) and round(row.accuracy, 5) == 0.92328


def test_earliest_best_epoch(spark):
    results = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "epoch int, accuracy double")
    assert metrics.best_epoch(results).first().epoch == 2


def test_weighted_batches(spark):
    scores = spark.createDataFrame([(0, 0.9, 1), (0, 0.9, 1), (0, 0.1, 1), (1, 0.1, 0)], "batch int, prob double, y int")
    assert metrics.batch_weighted_accuracy(scores).first().accuracy == pytest.approx(0.75)
    assert metrics.batch_weighted_accuracy(scores.limit(0)).first().accuracy == 0.0


def test_class_summary(spark):
    rows = spark.createDataFrame([("train", 1), ("train", 0), ("test", 0)], "split string, label int")
    found = {r.split: (r.instances, r.anomaly, r.normal) for r in metrics.class_summary(rows).collect()}
    assert found == {"total": (3, 1, 2), "train": (2, 1, 1), "test": (1, 0, 1)}
    assert metrics.union_batches([rows, rows]).where(F.col("label") == 1).count() == 2
