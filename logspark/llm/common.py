"""What the corpus operators share: their input columns, and a way to cut work into even parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.session import spread

#: Rows whose remainder is 0 are held out; models learn from the others only.
FOLDS = 5


def read(spark, folder: str, table: str) -> DataFrame:
    """A table; ``documents`` in one or two small files are dealt to all cores."""
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    return spread(rows) if table == "documents" else rows


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of any table that has them; a null text is empty. Other columns play no part."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves no remainder; a row without id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


_STRIP = ".,;:!?\"'()[]{}<>|#$%&*+-/\\=_~`^@«»“”„…—–"


def ngrams(words: list[str], shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of every word, for many words at once.

    A word is taken without marks around it and with a sign at both ends.
    """
    text = "".join([f"<{word.strip(_STRIP) or word}>" for word in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(word.strip(_STRIP) or word) + 2 for word in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, found = [], []
    mixed = np.zeros(len(points), np.uint64)
    for n in range(1, longest + 1):
        if len(points) < n:
            break
        mixed = (mixed[:len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ points[n - 1:]
        if n < shortest:
            continue
        inside = owner[n - 1:] == owner[:len(points) - n + 1]
        final = mixed * np.uint64(0xD6E8FEB86659FD93)
        found.append(((final >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)[inside])
        rows.append(owner[:len(points) - n + 1][inside])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(rows), np.concatenate(found)
