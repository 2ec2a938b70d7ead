"""The key at a given place of an order, without sorting the table.

Rows are counted by coarse bins of the order; only the bin in which the place lies is looked at again, until it is small enough
for one top-n. A seeded order is a hash, so its leading bits are even bins. In the plain order of the key a sample of keys,
drawn by hash, gives the borders of the bins. No row is moved: each pass combines counts before its shuffle, and only the
key column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Rows a bin may have to be ordered in one go.
SMALL = 100_000
#: Leading bits of the hash that a pass looks at.
BITS = 14
#: Bins of a pass in plain order.
BINS = 256


def shuffle_key(key: str, seed: int) -> Column:
    """Sort key of the seeded permutation: the same row always gets the same place."""
    return F.xxhash64(F.lit(seed).cast("bigint"), F.col(key))


def order_of(key: str, seed: int | None) -> list[Column]:
    """Seeded order, or plain key order when there is no seed."""
    return [F.col(key)] if seed is None else [shuffle_key(key, seed), F.col(key)]


def place_of(key: str, seed: int | None) -> Column:
    return F.struct(*[c.alias(f"_{n}") for n, c in enumerate(order_of(key, seed))])


def _binned(keys: DataFrame, bin_: Column, rank: int) -> tuple[int, int, int]:
    """The bin with the row of that rank, the rows before it and its rows."""
    before = 0
    for row in keys.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect():
        if rank <= before + row["n"]:
            return row["bin"], before, row["n"]
        before += row["n"]
    raise ValueError(f"no row of rank {rank} among {before}")


def _tree(key: str, borders: list, low: int, high: int) -> Column:
    """Number of ``borders`` below the key, which lies between ``low`` and ``high``: as many comparisons as a binary search."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(F.col(key) <= F.lit(borders[middle]), _tree(key, borders, low, middle)).otherwise(
        _tree(key, borders, middle + 1, high))


def _by_hash(keys: DataFrame, key: str, seed: int, rank: int, shift: int) -> tuple[DataFrame, int, int]:
    bin_ = F.shiftright(shuffle_key(key, seed), shift)
    found, before, rows = _binned(keys, bin_, rank)
    return keys.where(bin_ == F.lit(found)), before, rows


def _by_sample(keys: DataFrame, key: str, rank: int) -> tuple[DataFrame, int, int]:
    # The smallest hashes: each task sends as many rows as there are bins.
    drawn = keys.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(BINS - 1).collect()
    borders = sorted({row[0] for row in drawn})
    bin_ = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(_tree(key, borders, 0, len(borders)))
    found, before, rows = _binned(keys, bin_, rank)
    if found < 0:
        return keys.where(F.col(key).isNull()), before, rows
    inside = F.col(key).isNotNull()
    if found > 0:
        inside = inside & (F.col(key) > F.lit(borders[found - 1]))
    if found < len(borders):
        inside = inside & (F.col(key) <= F.lit(borders[found]))
    return keys.where(inside), before, rows


def place_at(keys: DataFrame, key: str, seed: int | None, rank: int, total: int) -> Row:
    """The :func:`place_of` the row of ``rank``, from 1, among the ``total`` rows of ``keys``."""
    shift = 64 - BITS
    while total > SMALL:
        if seed is None:
            keys, before, rows = _by_sample(keys, key, rank)
        elif shift >= 0:
            keys, before, rows = _by_hash(keys, key, seed, rank, shift)
            shift = shift - BITS if shift == 0 or shift > BITS else 0
        else:
            break
        if seed is None and rows == total:  # one key over and over
            return keys.select(place_of(key, seed).alias("place")).first()["place"]
        rank, total = rank - before, rows
    return keys.select(place_of(key, seed).alias("place")).orderBy("place").offset(rank - 1).limit(1).first()["place"]
