"""SimHash near-duplicates by Golay-code fuzzy hashing.

Each text becomes a 64-bit fingerprint of its word shingles. Texts with equal fingerprints are one class;
everything after works on different fingerprints only, so a copy that a third of all rows share is one.

Linking. A fingerprint is cut in three segments, each read as a 23-bit word of the perfect Golay code,
in which every word lies within 3 bits of exactly one codeword. Take two fingerprints that differ in at most 4
bits: half-way between them lies a third one within 2 bits of each. Its three nearest codewords
are the shared key. Seen from either end the 2 errors fall on the segments as 2+0+0, 1+1+0 or less, and
a segment with e errors has that codeword within 3 + e bits. So a fingerprint's keys are the triples of
codeword indices within (3+e1, 3+e2, 3+e3) bits with e1 + e2 + e3 <= 2: about 120 keys of 36 bits, and no link is
lost. Candidates that share a key are verified by counting bits.

Large groups. A key with more than ``BUCKET`` fingerprints isn't paired up. Its members go another exact way: each
lists all 2,081 fingerprints within 2 bits; those who list the same one are at most 4 bits apart, and any
two within 4 bits list a common one. So all who share one are tied to the first of them: as
many links as members, not as pairs, and the same components.

Cases: null or empty text has fingerprint 0 and links like any other; fewer words than a shingle are one shingle;
repeated rows share a class; rows without doc_id get a class but never name one; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import texts
from logspark.llm.components import components
from logspark.session import written

WORDS = 4
DISTANCE = 4
SEED = 42
BUCKET = 48
#: Bits of the three segments; each fits a 23-bit word, the rest of which is 0.
SEGMENTS = (21, 21, 22)
#: The generator polynomial of the binary Golay code.
GOLAY = 0b110001110101


# ---- fingerprints -------------------------------------------------------------------------------

def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits: 1 where over half the shingles' hashes have a 1."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate(len(part) + 1 for part in parts))
    starts = [0, *ends]
    hashes = np.array([xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(
        starts, ends[words - 1:] or ends[-1:])], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 50_000):
        bits = np.unpackbits(hashes[at:at + 50_000].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py(), words) for text in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- Golay keys ---------------------------------------------------------------------------------

def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@cache
def _shells() -> list[tuple[np.ndarray, np.ndarray]]:
    """Per number of errors e = 0, 1, 2 and syndrome: index changes to the codewords that 3 + e bits reach and
    fewer don't, as a padded table and its mask."""
    patterns, weights = [0], [0]
    for weight in range(1, 6):
        for places in combinations(range(23), weight):
            patterns.append(sum(1 << p for p in places))
            weights.append(weight)
    patterns, weights = np.array(patterns), np.array(weights)
    syndromes = _syndromes(patterns)
    shells = []
    for errors in range(3):
        chosen = np.flatnonzero(weights <= 3 if errors == 0 else weights == 3 + errors)
        order = chosen[np.argsort(syndromes[chosen], kind="stable")]
        counts = np.bincount(syndromes[order], minlength=2048)
        column = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        table = np.zeros((2048, counts.max()), np.int64)
        mask = np.zeros(table.shape, bool)
        table[syndromes[order], column] = patterns[order] >> 11
        mask[syndromes[order], column] = True
        shells.append((table, mask))
    return shells


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: the keys of each of ``fps`` (unsigned)."""
    segments, shift = [], 0
    for bits in SEGMENTS:
        word = (fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndrome = _syndromes(word)
        segments.append([((word >> 11)[:, None] ^ table[syndrome], mask[syndrome]) for table, mask in _shells()])
        shift += bits
    rows, keys = [], []
    number = np.arange(len(fps))
    for errors in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2),
                   (1, 1, 0), (1, 0, 1), (0, 1, 1)):
        (x, has_x), (y, has_y), (z, has_z) = (segment[e] for segment, e in zip(segments, errors))
        key = x[:, :, None, None] << 24 | y[:, None, :, None] << 12 | z[:, None, None, :]
        has = has_x[:, :, None, None] & has_y[:, None, :, None] & has_z[:, None, None, :]
        keys.append(key[has])
        rows.append(np.broadcast_to(number[:, None, None, None], has.shape)[has])
    return np.concatenate(rows), np.concatenate(keys)


def midpoints(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint within 2 bits) pairs."""
    bits = [np.uint64(1 << p) for p in range(64)]
    flips = np.array([np.uint64(0), *bits, *[a | b for a, b in combinations(bits, 2)]])
    return np.repeat(np.arange(len(fps)), len(flips)), (fps[:, None] ^ flips).ravel()


def _keyed(classes: DataFrame, keys: Callable, rows_at_once: int) -> DataFrame:
    """(key, fp), sorted by both within partitions that hold whole keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(every), rows_at_once):
                fps = every[at:at + rows_at_once]
                row, key = keys(fps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(fps[row].view(np.int64))], ["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key bigint, fp bigint").repartition("key").sortWithinPartitions(
        "key", "fp")


# ---- links --------------------------------------------------------------------------------------

def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column(0)), np.asarray(batch.column(1))


def _emit(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def pairs_in_runs(batches: Iterator[pa.RecordBatch], most: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Verified pairs of equal keys; members of keys with over ``most`` rows come with a null partner.

    Rows arrive sorted by key; what is kept between batches is one unfinished run, ``most`` rows at most.
    """
    kept_key, kept_fp, large = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in batches:
        key, fp = _columns(batch)
        key, fp = np.concatenate([kept_key, key]), np.concatenate([kept_fp, fp])
        if large is not None:
            same = int(np.searchsorted(key != large, True)) if (key != large).any() else len(key)
            if same:
                yield _emit(fp[:same], [None] * same)
            key, fp = key[same:], fp[same:]
            if not len(key):
                kept_key, kept_fp = key, fp
                continue
            large = None
        opened = int(np.flatnonzero(key == key[-1])[0]) if len(key) else 0
        yield from _pairs(key[:opened], fp[:opened], most, distance)
        kept_key, kept_fp = key[opened:], fp[opened:]
        if len(kept_key) > most:
            large = kept_key[0]
            yield _emit(kept_fp, [None] * len(kept_fp))
            kept_key, kept_fp = kept_key[:0], kept_fp[:0]
    yield from _pairs(kept_key, kept_fp, most, distance)


def _pairs(key: np.ndarray, fp: np.ndarray, most: int, distance: int) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    size = np.repeat(sizes, sizes)
    if (over := fp[size > most]).size:
        yield _emit(over, [None] * len(over))
    several = (size > 1) & (size <= most)
    key, fp = key[several], fp[several]
    for step in range(1, most):
        at = np.flatnonzero(key[step:] == key[:-step])
        if not len(at):
            return
        a, b = fp[at], fp[at + step]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
        if near.any():
            yield _emit(a[near], b[near])


def first_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's fingerprint with the first one of its key, unless it is that."""
    last = None
    for batch in batches:
        key, fp = _columns(batch)
        if not len(key):
            continue
        new = np.r_[last is None or key[0] != last[0], key[1:] != key[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(at >= 0, fp[at], last[1] if last else 0)
        last = key[-1], first[-1]
        if not new.all():
            yield _emit(first[~new], fp[~new])


def links(classes: DataFrame, most: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """(a, b) between different fingerprints of ``classes``, enough for the components within ``distance`` bits."""
    if not 0 <= distance <= 4:
        raise ValueError("the keys cover at most 4 differing bits")
    keyed = _keyed(classes, golay_keys, 2_000)
    found = written(keyed.mapInArrow(
        lambda batches: pairs_in_runs(batches, most, distance), "a bigint, b bigint").distinct(), "links")
    small = found.where("b is not null")
    large = found.where("b is null").select(F.col("a").alias("fp"))
    if large.isEmpty():
        return small
    if distance < 4:
        raise ValueError("large groups are tied at a distance of 4 only")
    tied = _keyed(large.repartition("fp"), midpoints, 200).mapInArrow(first_of_runs, "a bigint, b bigint")
    return small.unionByName(tied.distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): ``component_id`` is the smallest doc_id reachable over links, itself included."""
    prints = written(fingerprints(docs, words), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    grouped = components(links(classes, distance=distance))
    # Only fingerprints with a link take part; the others are components of their own.
    members = written(grouped.join(classes, F.col("node") == F.col("fp")).select("root", "fp", "first"), "members")
    lowest = members.groupBy("root").agg(F.min("first").alias("_low"))
    linked = members.join(lowest, "root").select("fp", "_low")
    # Written, so that Spark may split the join on a fingerprint that many documents have.
    named = written(classes.join(linked, "fp", "left").select("fp", F.coalesce("_low", "first").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs``, all columns, with one row of each group of near-duplicates."""
    return first_of_groups(docs, near_duplicates(docs, words, distance))


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each of ``groups`` (doc_id, component_id): that of the smallest doc_id.

    Rows that share a doc_id count as one document, of which one row stays. Rows without doc_id can't be told
    apart by it and stay.
    """
    found = written(groups.where("doc_id is not null"), "groups")
    ids = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.col("component_id") == F.col("doc_id")).alias("_stays"))
    gone = ids.where("not _stays").select(F.col("doc_id").alias("_id"))
    own = docs["doc_id"].cast("bigint")
    kept = docs.join(gone, own == gone["_id"], "left_anti")
    repeated = written(ids.where("_stays and _n > 1").select(F.col("doc_id").alias("_id")), "repeated")
    if repeated.isEmpty():
        return kept
    several = kept.join(repeated, own == repeated["_id"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, own == repeated["_id"], "left_anti").unionByName(several)
