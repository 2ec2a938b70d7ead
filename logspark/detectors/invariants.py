"""Linear invariants between event counts (Lou et al., USENIX ATC 2010), pairs of events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.detectors.kept import keep_settings, kept_settings
from logspark.detectors.vectors import distinct_vectors, gram, weighted_sums
from logspark.session import written

Pair = tuple[str, str, int, int]  # columns i and j, factors a and b of a*i + b*j = 0


@dataclass
class InvariantDetector:
    columns: list[str]
    dimension: int
    invariants: list[Pair]
    support: list[float]
    support_nonzero: list[float]

    def transform(self, matrix: DataFrame) -> DataFrame:
        return flag_violations(matrix, self.invariants)

    def save(self, path: str) -> None:
        """Replace what is at ``path``."""
        keep_settings(path, vars(self))

    @classmethod
    def load(cls, path: str) -> InvariantDetector:
        kept = kept_settings(path)
        return cls(**{**kept, "invariants": [tuple(pair) for pair in kept["invariants"]]})


def broken(pair: Pair) -> Column:
    first, second, a, b = pair
    return F.lit(a) * F.col(first).cast("bigint") + F.lit(b) * F.col(second).cast("bigint") != 0


def flag_violations(matrix: DataFrame, invariants: list[Pair]) -> DataFrame:
    """Add ``score`` (broken invariants) and ``pred`` (1 when any is broken)."""
    score = reduce(lambda x, y: x + y, [broken(p).cast("int") for p in invariants], F.lit(0))
    return matrix.withColumn("score", score).withColumn("pred", (F.col("score") > 0).cast("int"))


def pair_factors(squares_i: float, products: float, squares_j: float) -> tuple[int, int] | None:
    """Integer factors from the smallest eigenvector of a pair's 2 x 2 matrix.

    One of them is 1 or -1, and the first is positive.
    """
    if squares_i == 0 and squares_j == 0:
        return None
    half = np.hypot((squares_i - squares_j) / 2.0, products)
    smallest = (squares_i + squares_j) / 2.0 - half
    # Two forms of the same vector; the longer one is the accurate one.
    forms = [np.array([products, smallest - squares_i]), np.array([smallest - squares_j, products])]
    vector = max(forms, key=np.linalg.norm)
    size = np.abs(vector)
    if size.min() <= 1e-9 * max(size.max(), 1e-300):
        return None
    scaled = np.rint(vector / size.min() * np.sign(vector[0])).astype(int)
    return int(scaled[0]), int(scaled[1])


def candidate_pairs(products: np.ndarray, columns: list[str]) -> list[Pair]:
    """All column pairs that have an integer relation, in column order."""
    found: list[Pair] = []
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            factors = pair_factors(products[i, i], products[i, j], products[j, j])
            if factors is not None:
                found.append((columns[i], columns[j], *factors))
    return found


def supports(rows: DataFrame, columns: list[str], pairs: list[Pair]) -> tuple[np.ndarray, np.ndarray]:
    """Share of sessions keeping each invariant: of all, and of those with either event."""
    first = [columns.index(p[0]) for p in pairs]
    second = [columns.index(p[1]) for p in pairs]
    a, b = np.array([p[2] for p in pairs], float), np.array([p[3] for p in pairs], float)
    m = len(pairs)

    def kept(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        x, y = values[:, first], values[:, second]
        holds, present = (a * x + b * y) == 0, (x != 0) | (y != 0)
        return np.concatenate([weights @ holds, weights @ (holds & present), weights @ present, [weights.sum()]])

    sums = weighted_sums(rows, columns, 3 * m + 1, kept)
    total, present = max(sums[-1], 1.0), sums[2 * m:3 * m]
    return sums[:m] / total, np.divide(sums[m:2 * m], present, out=np.zeros(m), where=present > 0)


def space_dimension(
    rows: DataFrame, columns: list[str], products: np.ndarray, keep: float, epsilon: float,
) -> int:
    """Directions, smallest variance first, that nearly all sessions hold close to zero."""
    _, vectors = np.linalg.eigh(products)

    def close(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.append(weights @ (np.abs(values @ vectors) < epsilon), weights.sum())

    sums = weighted_sums(rows, columns, len(columns) + 1, close)
    share = sums[:-1] / max(sums[-1], 1.0)
    below = np.flatnonzero(share < keep)
    return int(below[0]) if len(below) else len(columns)


def fit_invariants(
    matrix: DataFrame, columns: list[str], keep: float = 0.98, epsilon: float = 0.5,
) -> InvariantDetector:
    """Pairs in column order whose invariant at least ``keep`` of the sessions hold, up to the dimension.

    Three passes over the distinct vectors, whatever the number of candidate pairs.
    """
    rows = written(distinct_vectors(matrix, columns), "distinct")
    products = gram(rows, columns)[1:, 1:]
    dimension = space_dimension(rows, columns, products, keep, epsilon)
    candidates = candidate_pairs(products, columns)
    if not candidates:
        return InvariantDetector(columns, dimension, [], [], [])
    share, share_nonzero = supports(rows, columns, candidates)
    chosen = [n for n in range(len(candidates)) if share[n] >= keep][:dimension]
    return InvariantDetector(
        columns, dimension, [candidates[n] for n in chosen],
        [float(share[n]) for n in chosen], [float(share_nonzero[n]) for n in chosen])
