"""Repeatable shuffles, caps and splits that do not depend on how the rows are partitioned.

Only the key column is looked at to find the keys at the borders of the parts (:mod:`selection`), a row or two per
class; these are then compared with each row where it lies: whole rows are never shuffled.

The input is read several times. So that it is worked out once, and the borders fit the rows, it is written first; pass
``stage_input=False`` for a table that is read from files as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from logspark.operators.selection import order_of, place_at, place_of, shuffle_key
from logspark.session import written

__all__ = ["cap_traces", "positional_split", "seeded_shuffle", "shuffle_key", "stratified_split"]


def _upto(key: str, seed: int | None, border: Row | None) -> Column:
    """Whether a row stands at ``border`` or before it; None is before all rows."""
    if border is None:
        return F.lit(False)
    at = F.struct(*[F.lit(value).alias(f"_{n}") for n, value in enumerate(border)])
    return place_of(key, seed) <= at


def _staged(df: DataFrame, stage_input: bool) -> DataFrame:
    return written(df, "split") if stage_input else df


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a seeded random order; a range sort, not a gather."""
    return df.orderBy(*order_of(key, seed))


def cap_traces(df: DataFrame, key: str, n: int, seed: int | None = 42, stage_input: bool = True) -> DataFrame:
    """The first ``n`` rows of the permutation; ``key`` is unique."""
    if n <= 0:
        return df.limit(0)
    rows = _staged(df, stage_input)
    keys = rows.select(key)
    total = keys.count()
    return rows if n >= total else rows.where(_upto(key, seed, place_at(keys, key, seed, n, total)))


def positional_split(
    df: DataFrame, key: str, val_frac: float = 0.1, test_frac: float = 0.1, seed: int | None = 42, stage_input: bool = True,
) -> DataFrame:
    """Add ``split``: train first, then val, then test, by position in the permutation; ``key`` is unique."""
    rows = _staged(df, stage_input)
    keys = rows.select(key)
    n = keys.count()
    n_test, n_val = int(n * test_frac), int(n * val_frac)
    n_train = n - n_val - n_test
    if n_train <= 0:
        raise ValueError("no rows left for training: lower val_frac or test_frac")
    last_train = place_at(keys, key, seed, n_train, n) if n_train < n else None
    last_val = place_at(keys, key, seed, n_train + n_val, n) if n_val and n_test else last_train
    part = F.lit("train")
    if n_train < n:
        rest = F.when(_upto(key, seed, last_val), "val").otherwise("test") if n_test else F.lit("val")
        part = F.when(_upto(key, seed, last_train), "train").otherwise(rest)
    return rows.withColumn("split", part)


def stratified_split(
    df: DataFrame, key: str, label: str, train_frac: float = 0.5, seed: int | None = 42, stage_input: bool = True,
) -> DataFrame:
    """Add ``split`` (train / test) with the same share of every class, rounded down in train.

    ``key`` is unique; one border per class comes to the driver, so ``label`` is to have few values.
    """
    rows = _staged(df, stage_input)
    keys = rows.select(key, label)
    train = F.lit(False)
    for found in keys.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect():
        own = F.col(label).eqNullSafe(F.lit(found[label]).cast(df.schema[label].dataType))
        rank = int(found["n"] * train_frac)
        if rank:
            train = train | (own & _upto(key, seed, place_at(keys.where(own), key, seed, rank, found["n"])))
    return rows.withColumn("split", F.when(train, "train").otherwise("test"))
