"""Squared prediction error outside the principal subspace (Xu et al., SOSP 2009)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.detectors.kept import keep_settings, kept_settings
from logspark.detectors.vectors import distinct_vectors, dot, gram, idf_weights

# Fixed value: normal deviate of the 99.9 % confidence level of the threshold.
C_ALPHA = 3.2905


@dataclass
class PcaDetector:
    columns: list[str]
    scale: np.ndarray
    mean: np.ndarray
    components: np.ndarray
    threshold: float

    def transform(self, matrix: DataFrame) -> DataFrame:
        """Add ``score`` (squared prediction error) and ``pred``."""
        squares = F.lit(0.0)
        for name, scale, mean in zip(self.columns, self.scale, self.mean):
            centred = F.col(name) * F.lit(float(scale)) - F.lit(float(mean))
            squares = squares + centred * centred
        for component in self.components:
            part = dot(self.columns, component * self.scale, -float(component @ self.mean))
            squares = squares - part * part
        score = F.greatest(squares, F.lit(0.0))
        return matrix.withColumn("score", score).withColumn(
            "pred", (F.col("score") > self.threshold).cast("int"))

    def save(self, path: str) -> None:
        """Replace what is at ``path``."""
        keep_settings(path, vars(self))

    @classmethod
    def load(cls, path: str) -> PcaDetector:
        kept = kept_settings(path)
        components = np.array(kept["components"], float).reshape(-1, len(kept["columns"]))
        return cls(**{**kept, "components": components, "scale": np.array(kept["scale"]), "mean": np.array(kept["mean"])})


def q_statistic(rest: np.ndarray, c_alpha: float = C_ALPHA) -> float:
    """Threshold from the eigenvalues outside the subspace (Jackson and Mudholkar, 1979)."""
    phi1, phi2, phi3 = (float(np.sum(rest**power)) for power in (1, 2, 3))
    if phi1 <= 0 or phi2 <= 0:
        return 0.0
    h0 = 1.0 - 2.0 * phi1 * phi3 / (3.0 * phi2**2)
    inner = c_alpha * np.sqrt(2.0 * phi2 * h0**2) / phi1 + 1.0 + phi2 * h0 * (h0 - 1.0) / phi1**2
    if inner <= 0 or h0 == 0:
        # The approximation breaks down; fall back to the normal one for a sum of squares.
        return phi1 + c_alpha * float(np.sqrt(2.0 * phi2))
    return float(phi1 * inner ** (1.0 / h0))


def fit_pca(
    matrix: DataFrame, columns: list[str], components: int | float = 5, weighting: str = "tf-idf",
    threshold: float | None = None,
) -> PcaDetector:
    """``components``: a number, or the share of variance to keep.

    Mean and covariance come from one pass of sums; only the events x events matrix is solved here.
    """
    rows = distinct_vectors(matrix, columns)
    scale = idf_weights(rows, columns) if weighting == "tf-idf" else np.ones(len(columns))
    sums = gram(rows, columns)
    n = max(sums[0, 0], 1.0)
    mean = sums[0, 1:] / n * scale
    covariance = sums[1:, 1:] / n * np.outer(scale, scale) - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.clip(values[::-1], 0.0, None), vectors[:, ::-1]
    if isinstance(components, float):
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        components = int(np.searchsorted(share, components) + 1)
    # Something must be left to measure the error in.
    components = min(components, len(columns) - 1)
    limit = q_statistic(values[components:]) if threshold is None else threshold
    return PcaDetector(columns, scale, mean, vectors[:, :components].T, limit)
