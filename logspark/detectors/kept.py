"""Settings of a fitted detector, kept as one row of JSON in a place that only Spark may reach."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession


def _plain(value: object) -> object:
    if isinstance(value, np.ndarray):
        return value.tolist()
    return value.item() if isinstance(value, np.generic) else str(value)


def keep_settings(path: str, settings: dict) -> None:
    """Replace what is at ``path``. Numbers, texts, lists and arrays."""
    SparkSession.active().createDataFrame([(json.dumps(settings, default=_plain),)], "settings string").write.mode(
        "overwrite").parquet(f"{path}/settings")


def kept_settings(path: str) -> dict:
    return json.loads(SparkSession.active().read.parquet(f"{path}/settings").first()["settings"])
