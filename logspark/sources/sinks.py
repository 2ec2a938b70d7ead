"""Writers. CSV where the format is a hand-over, Parquet where another job reads on.

Every writer sorts by range where order is asked for, and writes a folder of part files.
"""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions import columns as C


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, escape='"', emptyValue="", nullValue="",
                                       ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_templates(stats: DataFrame, path: str) -> None:
    ordered = stats.orderBy(C.event_number(F.col("event_id")), "event_id")
    _csv(ordered.select(
        F.col("event_id").alias("EventId"), F.col("event_template").alias("EventTemplate"),
        F.col("occurrences").alias("Occurrences")), path)


def write_traces(features: DataFrame, path: str) -> None:
    """``Type`` is blank where a session has no error event, and in all rows but the first of a cut session.

    ``Segment`` tells the rows of a cut session apart; it is 0 for all others.
    """
    names = {"block_id": "BlockId", "segment": "Segment", "label": "Label", "type": "Type", "features": "Features",
             "time_interval": "TimeInterval", "latency": "Latency"}
    ordered = features.orderBy("block_id", "segment")
    _csv(ordered.select(*[F.col(c).alias(name) for c, name in names.items()]), path)


def write_matrix(matrix: DataFrame, events: list[str], path: str) -> None:
    _csv(matrix.orderBy("block_id").select(F.col("block_id").alias("BlockId"), *events), path)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """``block_id, segment, x_data array<int>, y_data``, for :func:`datasets.load_traces`."""
    sequences.write.mode("errorifexists").parquet(path)


def write_labels(labelled: DataFrame, path: str) -> None:
    """Every session with its label as given, 0 by default."""
    _csv(labelled.orderBy("block_id").select(
        F.col("block_id").alias("BlockId"), F.col("label").alias("Label")), path)


def write_pr_curve(curve: DataFrame, summary: DataFrame, path: str) -> None:
    curve.write.mode("errorifexists").parquet(f"{path}/points")
    summary.write.mode("errorifexists").parquet(f"{path}/summary")


def save_best_model(model: MLWritable, path: str) -> None:
    """Weights and parameters of the chosen model; ``path`` is replaced when a better one is found."""
    model.write().overwrite().save(path)
