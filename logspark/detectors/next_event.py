"""Next-event model: what usually follows a short context (rule of Du et al., CCS 2017)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.detectors.kept import keep_settings, kept_settings
from logspark.operators.sequences import next_event_pairs
from logspark.operators.skew import DEFAULT, Limits
from logspark.session import sized


def top_followers(pairs: DataFrame, g: int) -> DataFrame:
    """``context, next`` for the ``g`` most frequent followers of each context, ties by text.

    Counts combine before the shuffle; a context then has at most as many rows as there are events.
    """
    counts = pairs.groupBy("context", "next").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("context").orderBy(F.desc("n"), "next"))
    return counts.withColumn("_place", place).where(F.col("_place") <= g).select("context", "next")


def flag_sessions(pairs: DataFrame, followers: DataFrame, key: str) -> DataFrame:
    """``key, pairs, unexpected, pred``: a session is anomalous when any event was not expected."""
    known = followers.withColumn("_known", F.lit(True))
    return (
        pairs.join(known, ["context", "next"], "left")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("_known").isNull()).alias("unexpected"))
        .withColumn("pred", (F.col("unexpected") > 0).cast("int"))
    )


@dataclass
class NextEventDetector:
    """``followers`` is a table, so scoring is a join, also on a stream."""

    followers: DataFrame
    key: str
    order: list[str]
    event: str
    history: int
    limits: Limits

    def transform(self, events: DataFrame) -> DataFrame:
        pairs = next_event_pairs(events, self.key, self.order, self.event, self.history, self.limits)
        flags = flag_sessions(pairs, self.followers, self.key)
        # Sessions too short for a single pair have nothing unexpected in them.
        sessions = events.select(self.key).distinct()
        return sessions.join(flags, self.key, "left").select(
            self.key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pairs", "unexpected", "pred")])


    def save(self, path: str) -> None:
        """Replace what is at ``path``."""
        self.followers.write.mode("overwrite").parquet(f"{path}/followers")
        keep_settings(path, {"key": self.key, "order": self.order, "event": self.event, "history": self.history,
                             "limits": vars(self.limits)})

    @classmethod
    def load(cls, path: str) -> NextEventDetector:
        kept = kept_settings(path)
        followers = SparkSession.active().read.parquet(f"{path}/followers")
        return cls(**{**kept, "followers": sized(followers), "limits": Limits(**kept["limits"])})


def fit_next_events(
    normal: DataFrame, key: str, order: list[str], event: str, history: int = 10, g: int = 9,
    limits: Limits = DEFAULT,
) -> NextEventDetector:
    """Fit on the events of normal sessions.

    The model is written once, and sent to all tasks when it is small: scoring then needs no shuffle
    on contexts, some of which are very frequent.
    """
    pairs = next_event_pairs(normal, key, order, event, history, limits)
    return NextEventDetector(sized(top_followers(pairs, g)), key, order, event, history, limits)
