"""Fit every detector on the training half and report both halves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.detectors.clustering import fit_clusters
from logspark.detectors.forest import fit_forest
from logspark.detectors.invariants import fit_invariants
from logspark.detectors.pca import fit_pca
from logspark.detectors.supervised import KINDS, fit_supervised
from logspark.operators import metrics
from logspark.session import written

METRICS = ["precision", "recall", "f1"]


def evaluate(name: str, detector, parts: dict[str, DataFrame], label: str) -> list[DataFrame]:
    """One row per part."""
    return [
        metrics.prf(metrics.confusion_of(detector.transform(rows).select("pred", F.col(label).alias("y")))).select(
            F.lit(name).alias("detector"), F.lit(part).alias("split"), *METRICS)
        for part, rows in parts.items()
    ]


def benchmark_report(
    matrix: DataFrame, columns: list[str], key: str, label: str, contamination: float = 0.03,
    max_distance: float = 0.3, settings: dict[str, dict] | None = None,
) -> DataFrame:
    """``detector, split, precision, recall, f1`` for a matrix with ``split`` train / test.

    ``settings`` names further arguments per detector. The matrix is written once and read by all fits and scores.
    """
    settings = settings or {}
    matrix = written(matrix, "halves")
    parts = {name: matrix.where(F.col("split") == name).drop("split") for name in ("train", "test")}
    train = parts["train"]
    detectors = {
        "pca": fit_pca(train, columns, **settings.get("pca", {})),
        "invariant_miner": fit_invariants(train, columns, **settings.get("invariant_miner", {})),
        "log_clustering": fit_clusters(
            train.where(F.col(label) == 0), columns, max_distance, **settings.get("log_clustering", {})),
        "isolation_forest": fit_forest(train, columns, key, contamination=contamination),
        **{kind: fit_supervised(train, columns, label, kind) for kind in KINDS},
    }
    rows = [row for name, detector in detectors.items() for row in evaluate(name, detector, parts, label)]
    return reduce(DataFrame.unionByName, rows)
