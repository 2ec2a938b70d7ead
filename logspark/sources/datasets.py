"""Labels, traces and split datasets."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.functions import columns as C
from logspark.sources.logs import number_rows

LABEL_SCHEMA = "block_id string, label int"


def label_columns(names: list[str]) -> tuple[str, str]:
    """Id and label column: the first whose trimmed lower-case name holds one of the words."""
    def first(words: tuple[str, str]) -> str:
        for name in names:
            if any(word in name.strip().lower() for word in words):
                return name
        raise ValueError(f"no column named like {words} in {names}")

    return first(("block", "id")), first(("label", "anomal"))


def normalise_labels(rows: DataFrame, order: str) -> DataFrame:
    """``block_id, label`` from a table with loosely named columns; of repeated ids the last row by ``order`` wins."""
    id_name, label_name = label_columns([c for c in rows.columns if c != order])
    place = F.col(order)
    typed = rows.select(
        F.col(f"`{id_name}`").cast("string").alias("block_id"),
        C.label_value(F.col(f"`{label_name}`")).alias("label"), place.alias("_row"))
    return dedupe_labels(typed, "_row")


def dedupe_labels(labels: DataFrame, order: str) -> DataFrame:
    return labels.groupBy("block_id").agg(F.max_by("label", order).alias("label"))


def load_labels(spark: SparkSession, path: str | None) -> DataFrame:
    """Label CSV; no path, or a path that is not there, means no labels: all sessions are normal."""
    empty = spark.createDataFrame([], LABEL_SCHEMA)
    if not path:
        return empty
    try:
        rows = number_rows(spark.read.csv(path, header=True), "_row")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            logging.getLogger(__name__).warning("no labels at %s: all sessions count as normal", path)
            return empty
        raise
    return normalise_labels(rows, "_row")


def check_traces(rows: DataFrame) -> DataFrame:
    """``x_data`` and ``y_data`` must be there, and present together in every row."""
    missing = {"x_data", "y_data"} - set(rows.columns)
    if missing:
        raise ValueError(f"traces need x_data and y_data, missing {sorted(missing)}")
    bad = F.col("x_data").isNull() | F.col("y_data").isNull()
    checked = F.when(bad, F.raise_error(F.lit("x_data and y_data differ in length")).cast("bigint")).otherwise(
        F.col("y_data").cast("bigint"))
    return rows.withColumn("y_data", checked)


def load_traces(spark: SparkSession, path: str) -> DataFrame:
    return check_traces(spark.read.parquet(path))


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder per split, so that reading one split reads only its files."""
    rows.write.mode("errorifexists").partitionBy("split").parquet(path)


def load_splits(spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
    """train / val / test of a partitioned dataset; train is required, the others may be missing."""
    rows = spark.read.parquet(path)
    parts = {name: rows.where(F.col("split") == name).drop("split") for name in ("train", "val", "test")}
    found = {name: None if part.isEmpty() else part for name, part in parts.items()}
    if found["train"] is None:
        raise ValueError("the dataset has no train split")
    return found


def typed_dataset(rows: DataFrame, x: str = "x", y: str | None = "y") -> DataFrame:
    """Token mode (one-dimensional integer rows) or feature mode (two-dimensional numeric rows).

    Integer labels become bigint, others float; ``y`` may be absent; other ranks are rejected.
    """
    rank, inner = 0, rows.schema[x].dataType
    while isinstance(inner, T.ArrayType):
        rank, inner = rank + 1, inner.elementType
    if rank not in (1, 2) or not isinstance(inner, T.NumericType):
        raise ValueError(f"x must hold one- or two-dimensional numbers per row, got {rows.schema[x].dataType.simpleString()}")
    element = "bigint" if isinstance(inner, T.IntegralType) else "float"
    target = element
    for _ in range(rank):
        target = f"array<{target}>"
    columns = [c for c in rows.columns if c not in (x, y)]
    typed = [F.col(x).cast(target).alias(x)]
    if y is not None and y in rows.columns:
        whole = isinstance(rows.schema[y].dataType, T.IntegralType)
        typed.append(F.col(y).cast("bigint" if whole else "float").alias(y))
    return rows.select(*columns, *typed)
