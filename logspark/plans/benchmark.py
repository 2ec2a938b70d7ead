"""Count matrix and labels -> halves -> every detector -> report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logspark.detectors.report import benchmark_report
from logspark.operators import metrics, sessions, split
from logspark.session import stage


def run_benchmark(
    matrix: DataFrame, labels: DataFrame, columns: list[str], contamination: float = 0.03, max_distance: float = 0.3,
) -> tuple[DataFrame, DataFrame]:
    """``(class summary, report)`` for a matrix keyed by block_id."""
    halves = stage(split.stratified_split(sessions.label_sessions(matrix, labels), "block_id", "label"))
    return (metrics.class_summary(halves),
            benchmark_report(halves, columns, "block_id", "label", contamination, max_distance))
