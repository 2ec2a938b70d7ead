"""Count vectors as wide int columns, and sums over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.features import occurrence_matrix
from logspark.session import sized


def count_vectors(
    train: DataFrame, test: DataFrame, events: list[str], key: str = "block_id", event: str = "event_id",
) -> tuple[DataFrame, DataFrame]:
    """Matrices of both sets with the columns of the training set; other events are not counted."""
    return occurrence_matrix(train, events, key, event), occurrence_matrix(test, events, key, event)


def distinct_vectors(matrix: DataFrame, columns: list[str], extra: list[str] | None = None) -> DataFrame:
    """Equal vectors as one row with their number in ``weight``.

    Sessions repeat a few shapes over and over, and the count combines before its shuffle, so this
    is small whatever the number of sessions, and a shape that a third of them share is one row.
    """
    return matrix.groupBy(*columns, *(extra or [])).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def score_by_vector(
    matrix: DataFrame, columns: list[str], score: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Score each distinct vector once and hand the result to every session that has it.

    The scored vectors go to all tasks when they are few; a join on the vector would bring the
    sessions of a frequent one together.
    """
    scored = sized(score(matrix.select(*columns).distinct()))
    return matrix.join(scored, columns, "left").select(
        *matrix.columns, *[c for c in scored.columns if c not in columns])


def assemble(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)


def weighted_sums(
    rows: DataFrame, columns: list[str], width: int, per_batch: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> np.ndarray:
    """Sum of ``per_batch(values, weights)``, a vector of ``width`` numbers, over all rows.

    Each task adds up its Arrow batches and gives ``width`` numbers; Spark sums those by position.
    """
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for batch in batches:
            total += per_batch(batch[columns].to_numpy(float), batch["weight"].to_numpy(float))
        yield pd.DataFrame({"position": np.arange(width), "value": total})

    sums = (
        rows.select(*columns, "weight").mapInPandas(part, "position int, value double")
        .groupBy("position").agg(F.sum("value").alias("value")).collect()
    )
    result = np.zeros(width)
    for row in sums:
        result[row["position"]] = row["value"]
    return result


def gram(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Weighted sums of products of all column pairs; row and column 0 stand for a constant 1."""
    size = len(columns) + 1

    def products(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        full = np.hstack([np.ones((len(values), 1)), values])
        return (full.T @ (full * weights[:, None])).ravel()

    return weighted_sums(rows, columns, size * size, products).reshape(size, size)


def idf_weights(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """log(sessions / sessions with the event); 0 for events no session has."""
    counts = rows.agg(
        F.sum("weight").alias("n"),
        *[F.sum(F.when(F.col(c) > 0, F.col("weight")).otherwise(0.0)).alias(f"with_{c}") for c in columns]).first()
    total = counts["n"] or 0.0
    return np.array([np.log(total / counts[f"with_{c}"]) if counts[f"with_{c}"] else 0.0 for c in columns])


def dot(columns: list[str], factors: np.ndarray, constant: float = 0.0) -> Column:
    """Linear form over columns, as one JVM expression."""
    total = F.lit(float(constant))
    for name, factor in zip(columns, factors):
        if factor != 0:
            total = total + F.col(name) * F.lit(float(factor))
    return total
