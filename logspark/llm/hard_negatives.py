"""Hard-negative mining by inner product, filtered by rotated one-bit codes.

For each anchor: its positives, the nearest other rows of its label; and for each positive the nearest rows of other labels
whose score lies within given shares of the positive's score.

Codes. Vectors are turned by one random rotation, and a vector u is replaced by the signs s of its components and
its alignment a = <u, s/√D>, the length along its own code. What is left, u - a s/√D, has length √(|u|² - a²), stored too;
it is coded again in the same way, ``LEVELS`` times, each code about 0.6 as long as the one before. A query q is cut to
whole numbers of 8 bits, one bit plane each, so <q, s/√D> comes from popcounts of (code & plane). The estimate of <u, q> is the sum of
alignment x product over the codes. It can be off by what is left of u times what is left of q beside the last code
(Cauchy-Schwarz) and by the cut of q, whose sum is known: an interval that holds for certain, with no probability
in it. Levels are looked at one after the other, and a pair goes as soon as its interval says that it can't
be among the results. The score of what survives is worked out in whole numbers; only these decide.

Scale. All rows are coded once and written. Anchors go in blocks of ``BLOCK_BYTES``, each sent to all tasks, which go over their rows in
tiles; vectors are never shuffled, so a common vector or label makes no task longer. Each task keeps the best few per anchor.
Before a pass over all rows, the same pass over a bounded sample gives each anchor a floor that its results can't fall under, so
a task sends on little. Results of the blocks go into one table. A block's positives, a few per anchor, come to the driver.

Cases: rows with a null label or vector, or null or non-finite components take no part, nor do rows without vec_id; vectors of
another length are not compared; a vec_id that stands several times with the same score counts once, and is never its own
positive or negative; each different anchor row is an anchor; fewer candidates than asked for give all; ties go to the smaller
vec_id; components beyond ``vectors.LIMIT`` count as that; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.llm.vectors import matrix, scaled, usable
from logspark.session import shared_path, written

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Scores of negatives lie between these percentages of the positive's score.
PERCENT = (50, 95)
LEVELS = 4
PLANES = 8
#: Anchors sent around at once, and pairs of rows and anchors looked at together.
BLOCK_BYTES = 16 << 20
PAIRS_AT_ONCE = 1 << 20
SCORED_AT_ONCE = 1 << 16
#: Rows of the sample that gives floors.
SAMPLE_ROWS = 50_000
#: More than the rounding of the rotation and the sums can be off, as a share of the lengths.
SLACK = 1e-9

_CODED = "vec_id bigint, label bigint, vec array<int>, code binary, align array<double>, left array<double>"


def prepared(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part; labels are whole numbers."""
    return table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        scaled(F.col("embedding"), scale).alias("vec"))


@dataclass
class Rotation:
    """A rotation of vectors filled up with zeros to whole words of 64 components."""

    turn: np.ndarray

    @classmethod
    def of(cls, length: int, seed: int = 42) -> Rotation:
        size = max(64, -(-length // 64) * 64)
        return cls(np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0])

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.astype(float) @ self.turn[:vectors.shape[1]]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def one_bit(turned: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``codes`` (row, level, word), ``align`` (row, level), and ``left`` (row, level + 1): lengths before and after each level."""
    size = turned.shape[1]
    rest = turned.copy()
    codes, align, left = [], [], [np.linalg.norm(rest, axis=1)]
    for _ in range(levels):
        up = rest >= 0
        sign = np.where(up, 1.0, -1.0) / np.sqrt(size)
        along = (rest * sign).sum(1)
        rest = rest - along[:, None] * sign
        codes.append(_packed(up))
        align.append(along)
        left.append(np.linalg.norm(rest, axis=1))
    return np.stack(codes, 1), np.stack(align, 1), np.stack(left, 1)


@dataclass
class Asked:
    """Turned queries, cut to ``PLANES`` bits: q is about low + step x number, and ``off`` bounds what a sign vector sees of the cut."""

    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    off: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, turned: np.ndarray) -> Asked:
        low = turned.min(1)
        step = (turned.max(1) - low) / ((1 << PLANES) - 1)
        step[step == 0] = 1.0
        number = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint64)
        cut = low[:, None] + step[:, None] * number
        planes = np.stack([_packed((number >> np.uint64(p)) & np.uint64(1) == 1) for p in range(PLANES)], 1)
        size = turned.shape[1]
        return cls(planes, low, step, cut.sum(1), np.abs(turned - cut).sum(1) / np.sqrt(size), np.linalg.norm(turned, axis=1))

    def along(self, codes: np.ndarray, row: np.ndarray | None, anchor: np.ndarray | slice) -> np.ndarray:
        """<q, s/√D> up to ``off``: of pairs, or without ``row`` of all rows (row, anchor)."""
        words = codes.shape[1]
        ones = np.zeros((len(codes), len(self.low[anchor])) if row is None else len(row), np.int32)
        held = np.zeros(ones.shape, np.int32)
        for word in range(words):
            own = codes[:, word, None] if row is None else codes[row, word]
            ones += np.bitwise_count(own)
            for plane in range(PLANES):
                held += np.bitwise_count(own & self.planes[anchor, plane, word]).astype(np.int32) << plane
        # The sum of q over the bits that are set, twice, less the sum of all of q.
        size = words * 64
        return (2 * (self.low[anchor] * ones + self.step[anchor] * held) - self.total[anchor]) / np.sqrt(size)


def survivors(
    asked: Asked, codes: np.ndarray, align: np.ndarray, left: np.ndarray, may: np.ndarray, least: np.ndarray, most: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, anchor) of ``may`` whose score can lie between ``least`` and ``most`` of the anchor."""
    row, anchor = np.nonzero(may)
    estimate, off = np.zeros(len(row)), np.zeros(len(row))
    for level in range(align.shape[1]):
        # Where most pairs are asked for, all are cheaper than one by one.
        if level == 0 and 4 * len(row) > may.size:
            part = asked.along(codes[:, level], None, slice(None))[row, anchor]
        else:
            part = asked.along(codes[:, level], row, anchor)
        estimate += align[row, level] * part
        off += align[row, level] * asked.off[anchor]
        length = asked.length[anchor]
        # Of q only what stands across the last code can meet what is left of the row.
        seen = np.maximum(np.abs(part) - asked.off[anchor], 0.0)
        across = np.sqrt(np.maximum(length**2 - seen**2, 0.0))
        width = left[row, level + 1] * across + off + SLACK * left[row, 0] * length + 1e-6
        kept = (estimate + width >= least[anchor]) & (estimate - width <= most[anchor])
        row, anchor, estimate, off = row[kept], anchor[kept], estimate[kept], off[kept]
    return row, anchor


def scores(vectors: np.ndarray, queries: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whole-number inner products of pairs."""
    found = np.empty(len(row), np.int64)
    for start in range(0, len(row), SCORED_AT_ONCE):
        part = slice(start, start + SCORED_AT_ONCE)
        found[part] = np.einsum("ij,ij->i", vectors[row[part]], queries[anchor[part]])
    return found


class Best:
    """The ``k`` best (score, id) of each of ``slots``, ties to the smaller id; equal pairs once."""

    def __init__(self, slots: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.slots = slots

    def add(self, slot: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        good = score >= self.floor[slot]
        if not good.any():
            return
        slot, score, own = (np.r_[old, new[good]] for old, new in ((self.slot, slot), (self.score, score), (self.id, own)))
        by = np.lexsort((own, -score, slot))
        slot, score, own = slot[by], score[by], own[by]
        new = np.r_[True, (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (own[1:] != own[:-1])]
        slot, score, own = slot[new], score[new], own[new]
        start = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - start
        kept = place < self.k
        last = place == self.k - 1
        self.floor[slot[last]] = np.maximum(self.floor[slot[last]], score[last])
        self.slot, self.score, self.id = slot[kept], score[kept], own[kept]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.slot, self.score, self.id)], ["slot", "score", "vec_id"])


_NONE = np.iinfo(np.int64).min // 4


@dataclass
class Block:
    """Anchors of one length that are sent around; positives are added by the first pass."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    asked: Asked
    positives: np.ndarray | None = None  # score (anchor, positive), _NONE where there are fewer
    positive_ids: np.ndarray | None = None

    def limits(self, percent: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest score of a negative (anchor, positive); an empty range where there is no positive."""
        low = -(-self.positives * percent[0] // 100)
        high = self.positives * percent[1] // 100
        none = self.positives == _NONE
        return np.where(none, -_NONE, low), np.where(none, _NONE, high)


def coded(rows: DataFrame, rotation: Rotation, levels: int) -> DataFrame:
    """The rows with codes, alignments and lengths of what is left."""
    sent = rows.sparkSession.sparkContext.broadcast(rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(2))
            codes, align, left = one_bit(sent.value(vectors), levels) if len(vectors) else (np.empty((0, 1, 1), np.uint64), [], [])
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([each.tobytes() for each in codes], pa.binary()),
                pa.array(list(align), pa.list_(pa.float64())), pa.array(list(left), pa.list_(pa.float64()))],
                ["vec_id", "label", "vec", "code", "align", "left"])

    return rows.mapInArrow(run, _CODED)


def _best(rows: DataFrame, block: Block, levels: int, k: int, floor: np.ndarray, percent: tuple[int, int] | None) -> DataFrame:
    """(slot, score, vec_id): per task the best rows of each slot. A slot is an anchor, whose own label is asked for; with
    ``percent`` an anchor and a positive, and other labels within the range are."""
    sent = rows.sparkSession.sparkContext.broadcast((block, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_floor = sent.value
        anchors = len(own.ids)
        best = Best(own_floor.size, k, own_floor.ravel())
        size = max(16, PAIRS_AT_ONCE // max(anchors, 1))
        most = np.full(anchors, -float(_NONE))
        if percent is not None:
            low, high = own.limits(percent)
            most = high.max(1).astype(float)
        for batch in batches:
            # Tiles grow, so that floors have risen before most rows are looked at.
            start, step = 0, min(64, size)
            while start < batch.num_rows:
                part = batch.slice(start, step)
                start, step = start + step, min(2 * step, size)
                ids, labels = np.asarray(part.column(0)), np.asarray(part.column(1))
                vectors = matrix(part.column(2))
                codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint64).reshape(len(ids), levels, -1)
                align = part.column(4).flatten().to_numpy().reshape(len(ids), -1)
                left = part.column(5).flatten().to_numpy().reshape(len(ids), -1)
                same = labels[:, None] == own.labels[None, :]
                may = (same if percent is None else ~same) & (ids[:, None] != own.ids[None, :])
                if percent is None:
                    least = best.floor.astype(float)
                else:
                    least = np.maximum(best.floor.reshape(low.shape), low).min(1).astype(float)
                row, anchor = survivors(own.asked, codes, align, left, may, least, most)
                score = scores(vectors, own.vectors, row, anchor)
                if percent is None:
                    best.add(anchor, score, ids[row])
                    continue
                for n in range(low.shape[1]):
                    inside = (score >= low[anchor, n]) & (score <= high[anchor, n])
                    best.add(anchor[inside] * low.shape[1] + n, score[inside], ids[row[inside]])
        yield best.batch()

    return rows.mapInArrow(run, "slot bigint, score bigint, vec_id bigint")


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The best ``k`` over all tasks, with their ``rank``."""
    rank = F.row_number().over(W.partitionBy("slot").orderBy(F.desc("score"), "vec_id"))
    return parts.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def _floors(sample: DataFrame | None, block: Block, levels: int, k: int, shape: tuple, percent=None) -> np.ndarray:
    """Per slot the k-th best score of the sample, which the k-th of all rows can't fall under."""
    floor = np.full(shape, _NONE)
    if sample is not None:
        for row in _merged(_best(sample, block, levels, k, floor, percent), k).where(F.col("rank") == k).collect():
            floor.reshape(-1)[row["slot"]] = row["score"]
    return floor


def mined(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
    percent: tuple[int, int] = PERCENT, levels: int = LEVELS, block_bytes: int = BLOCK_BYTES, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``anchors`` against ``rows``, both (vec_id,
    label, vec). ``percent`` are not negative, the first not above the second."""
    spark = rows.sparkSession
    held, asked = written(rows, "vectors"), written(anchors.distinct(), "anchors")
    out = shared_path(spark, "mined")
    schema = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    spark.createDataFrame([], schema).write.parquet(out)
    # Vectors have one length as a rule; one row per length comes to the driver.
    for found in asked.groupBy(F.size("vec").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect():
        length = found["length"]
        rotation = Rotation.of(length)
        codes = written(coded(held.where(F.size("vec") == length), rotation, levels), "codes")
        n = codes.count()
        share = sample_rows / max(n, 1)
        sample = written(codes.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))), "sample") if share < 0.25 else None
        size = max(1, block_bytes // (8 * max(length, 64)))
        blocks = -(-found["n"] // size)
        own = asked.where(F.size("vec") == length).withColumn("_block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)))
        for number in range(blocks):
            picked = own.where(F.col("_block") == number).orderBy("vec_id", "label", "vec").collect()
            if picked:
                _mine_block(codes, sample, _block(picked, length, rotation), levels, positives, negatives, percent).write.mode(
                    "append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _block(picked: list, length: int, rotation: Rotation) -> Block:
    vectors = np.array([row["vec"] for row in picked], np.int64).reshape(len(picked), length)
    return Block(np.array([row["vec_id"] for row in picked], np.int64), np.array([row["label"] for row in picked], np.int64),
                 vectors, Asked.of(rotation(vectors)))


def _mine_block(codes, sample, block: Block, levels: int, positives: int, negatives: int, percent: tuple[int, int]) -> DataFrame:
    spark, anchors = codes.sparkSession, len(block.ids)
    floor = _floors(sample, block, levels, positives, (anchors,))
    block.positives = np.full((anchors, positives), _NONE)
    block.positive_ids = np.zeros((anchors, positives), np.int64)
    # A few rows per anchor of the block.
    for row in _merged(_best(codes, block, levels, positives, floor, None), positives).collect():
        block.positives[row["slot"], row["rank"] - 1] = row["score"]
        block.positive_ids[row["slot"], row["rank"] - 1] = row["vec_id"]
    shape = (anchors, positives)
    floor = _floors(sample, block, levels, negatives, shape, percent)
    found = _merged(_best(codes, block, levels, negatives, floor, percent), negatives)
    names = spark.sparkContext.broadcast((block.ids, block.positive_ids.ravel(), block.positives.ravel()))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, positive, score = names.value
        for batch in batches:
            slot = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[slot // positives]), pa.array(positive[slot]), batch.column(3), batch.column(2),
                pa.array(score[slot]), batch.column(1)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return found.select("slot", "score", "vec_id", "rank").mapInArrow(
        named, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
