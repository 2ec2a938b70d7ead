"""Structured lines -> sequences -> next-event model -> accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.detectors.next_event import fit_next_events
from logspark.operators import encode, metrics, sessions
from logspark.operators.skew import DEFAULT, Limits
from logspark.session import sized


def next_event_accuracy(
    lines: DataFrame, labels: DataFrame, history: int = 10, g: int = 9, limits: Limits = DEFAULT,
) -> DataFrame:
    """One row: normal, abnormal, fp, fn, tn, tp, accuracy.

    ``lines`` has line_id, content and event_id; the model learns from sessions labelled 0.
    """
    firsts = sessions.first_block_tuples(lines)
    coded = encode.encoder_transform(firsts, encode.lexical_rank(firsts))
    # Abnormal sessions are the few; those not named are normal.
    abnormal = sized(labels.where(F.col("label") != 0).select("block_id"))
    normal = coded.join(abnormal, "block_id", "left_anti")
    detector = fit_next_events(normal, "block_id", ["line_id"], "code", history, g, limits)
    flags = sessions.label_sessions(detector.transform(coded), labels).select("pred", F.col("label").alias("y"))
    totals = metrics.confusion_of(flags).select(
        (F.col("tn") + F.col("fp")).alias("normal"), (F.col("fn") + F.col("tp")).alias("abnormal"), "fp", "fn")
    return metrics.accuracy_from_totals(totals)
