"""Vector code compression: a product quantizer in whole numbers, its nearest entries found with a GNAT.

Vectors are cut into equal consecutive parts and each part is replaced by the number of the nearest of at most 256 entries of its
codebook. Codebooks start as the parts of the first vectors and are moved for a fixed number of rounds to the floor of the
mean of what is nearest to them.

GNAT (geometric near-neighbour access tree) over the entries of a codebook. A node has split points, some of its
entries chosen far apart; every other entry hangs below the split point nearest to it. For each pair of split point and
subtree the node stores the range of distances from the point to the entries of the subtree, itself included. A query is
compared with the split points; with a distance d to one and a best so far r, a subtree whose range doesn't meet
[d - r, d + r] can't hold anything as near as r and is left out whole. Distances are square roots, so every range is
widened and every radius rounded up by more than a float can err, and a subtree goes only if it is farther strictly: an entry at
equal distance is always compared, in whole numbers, and the lower index wins. The subtree of the nearest split point is
searched first, for a small radius. Many vectors go down the tree together.

Scale. Codebooks, at most 256 entries per part, are all that is sent around or comes to the driver. A round is one
pass in which each task adds up counts and sums of its entries; vectors are never shuffled, so a vector that a third of the rows share
costs what other rows cost. Spark adds the sums of the tasks up by place.

Cases: rows whose vector is null or holds null or non-finite components are left out, as are those of another length than
the commonest; a length that isn't a multiple of the parts is filled up with zeros, and an empty vector has code 0 in each part; components
beyond ``vectors.LIMIT`` count as that; a repeated row gives a row each time and counts as often, but a vec_id starts one
entry only, its smallest vector; rows without vec_id are coded and start none; fewer than 256 ids give that many entries; an
empty table gives no codes; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.vectors import LIMIT, commonest_length, matrix, scaled, usable
from logspark.session import sized, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Entries below which a node is compared as a whole.
LEAF = 16
SPLITS = 16
ROWS_AT_ONCE = 8_192
#: More than square roots and differences of floats can be off, as a share of their size.
SLACK = 2.0 ** -44


class Points:
    """Points with their squared lengths, in a kind of number that is exact for distances among ``most`` large ones."""

    def __init__(self, values: np.ndarray, most: int):
        # Whole numbers up to 2^53 are exact in both kinds.
        self.values = values.astype(np.float64 if 4 * values.shape[1] * most**2 < 1 << 53 else np.int64)
        self.lengths = (self.values * self.values).sum(1)

    def squared(self, own: np.ndarray, others: Points, their: np.ndarray) -> np.ndarray:
        """Exact squared distances of these points ``own`` to those ``their`` of ``others``."""
        found = self.values[own] @ others.values[their].T
        found *= -2
        found += self.lengths[own][:, None]
        found += others.lengths[their][None, :]
        return found


def _largest(values: np.ndarray) -> int:
    return int(np.abs(values).max(initial=0))


@dataclass
class Node:
    """``points``: entry numbers of the split points, or of all entries of a leaf. ``near`` and ``far``: ranges (point, subtree)."""

    points: np.ndarray
    children: list[Node | None] = field(default_factory=list)
    near: np.ndarray | None = None
    far: np.ndarray | None = None


def grow(entries: Points, own: np.ndarray) -> Node:
    """The tree over the entries ``own``; equal entries make a leaf of any size."""
    if len(own) <= LEAF:
        return Node(own)
    distance = entries.squared(own, entries, own)
    # Far apart: each further split point is the entry farthest from those chosen.
    chosen, nearest = [0], distance[0].copy()
    while len(chosen) < SPLITS and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distance[chosen[-1]])
    if len(chosen) == 1:
        return Node(own)
    below = distance[:, chosen].argmin(1)
    below[chosen] = np.arange(len(chosen))
    roots = np.sqrt(distance[chosen])
    children, near, far = [], [], []
    for n, point in enumerate(chosen):
        inside = below == n
        near.append(roots[:, inside].min(1) * (1 - SLACK))
        far.append(roots[:, inside].max(1) * (1 + SLACK))
        rest = inside.copy()
        rest[point] = False
        children.append(grow(entries, own[rest]) if rest.any() else None)
    return Node(own[chosen], children, np.array(near).T, np.array(far).T)


class Gnat:
    """Nearest entries of one codebook; ``compared`` counts exact distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = grow(Points(entries, _largest(entries)), np.arange(len(entries)))
        self.compared = 0

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest of equals, and the squared distance to it."""
        most = max(_largest(rows), _largest(self.entries))
        asked, entries = Points(rows, most), Points(self.entries, most)
        best = np.full(len(rows), len(self.entries), np.int64)
        least = np.full(len(rows), 1 << 62, asked.values.dtype)
        self._search(self.root, asked, entries, np.arange(len(rows)), best, least)
        return best, least.astype(np.int64)

    def _search(
        self, node: Node, rows: Points, entries: Points, asked: np.ndarray, best: np.ndarray, least: np.ndarray,
    ) -> None:
        found = rows.squared(asked, entries, node.points)
        self.compared += found.size
        # The lowest index among the nearest points of the node, then against the best so far.
        low = found.min(1)
        index = np.where(found == low[:, None], node.points, len(self.entries)).min(1)
        better = (low < least[asked]) | ((low == least[asked]) & (index < best[asked]))
        best[asked[better]], least[asked[better]] = index[better], low[better]
        if not node.children:
            return
        distance = np.sqrt(found)
        bound = np.zeros(found.shape)
        for n in range(len(node.points)):
            at = distance[:, n, None]
            np.maximum(bound, at * (1 - SLACK) - node.far[n], out=bound)
            np.maximum(bound, node.near[n] - at * (1 + SLACK), out=bound)
        closest = found.argmin(1)
        for first in (True, False):
            for n, child in enumerate(node.children):
                if child is None:
                    continue
                mine = np.flatnonzero((closest == n) == first)
                radius = np.sqrt(least[asked[mine]]) * (1 + SLACK)
                # A bound is a difference of numbers that may be far larger than itself.
                kept = mine[bound[mine, n] <= radius + distance[mine].max(1, initial=0.0) * SLACK]
                if len(kept):
                    self._search(child, rows, entries, asked[kept], best, least)


@dataclass
class Codebooks:
    """``entries`` (part, entry, component), whole numbers; ``length`` of the vectors they are for."""

    entries: np.ndarray
    length: int

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        """(part, row, component)."""
        parts, _, width = self.entries.shape
        filled = np.zeros((len(vectors), parts * width), np.int64)
        filled[:, :vectors.shape[1]] = vectors
        return filled.reshape(len(vectors), parts, width).transpose(1, 0, 2)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def prepared(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, whatever their length."""
    return table.where(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "label", scaled(F.col("embedding"), scale).alias("vec"))


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; None without rows."""
    length = commonest_length(rows, "vec")
    if length is None:
        return None
    own = rows.where((F.size("vec") == length) & F.col("vec_id").isNotNull())
    ids = own.select("vec_id").distinct().orderBy("vec_id").limit(entries)
    # At most 256 ids are sent around, and one vector for each comes back.
    first = own.join(F.broadcast(ids), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy("vec_id").collect()
    width = -(-length // parts)
    books = Codebooks(np.zeros((parts, len(first), width), np.int64), length)
    books.entries = books.cut(np.array([row["vec"] for row in first], np.int64).reshape(len(first), length)).copy()
    return books


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            yield part, matrix(part.column(at))


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry at the floor of the mean of the parts nearest to it; unused entries stay."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        parts, entries, width = own.entries.shape
        trees = [Gnat(each) for each in own.entries]
        total = np.zeros((parts, entries, width + 1), np.int64)
        for _, vectors in _blocks(batches, 0):
            for part, (tree, rows_) in enumerate(zip(trees, own.cut(vectors))):
                nearest, _ = tree.nearest(rows_)
                by = np.argsort(nearest, kind="stable")
                used, start = np.unique(nearest[by], return_index=True)
                total[part, used, :width] += np.add.reduceat(rows_[by], start, axis=0)
                total[part, used, width] += np.diff(np.r_[start, len(by)])
        flat = total.ravel()
        place = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(flat[place])], ["place", "total"])

    parts, entries, width = books.entries.shape
    added = np.zeros((parts, entries, width + 1), np.int64)
    # One row per component of an entry comes to the driver.
    for row in rows.select("vec").mapInArrow(sums, "place bigint, total bigint").groupBy("place").agg(
            F.sum("total").alias("total")).collect():
        added.reshape(-1)[row["place"]] = row["total"]
    count = added[..., width:]
    return Codebooks(np.where(count > 0, added[..., :width] // np.maximum(count, 1), books.entries), books.length)


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): entry numbers as two hex digits each, and the squared distance to them."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    label = rows.schema["label"].dataType.simpleString()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        trees = [Gnat(each) for each in own.entries]
        for batch, vectors in _blocks(batches, 2):
            error = np.zeros(len(vectors), np.int64)
            code = np.empty((len(vectors), len(trees)), np.uint8)
            for part, (tree, rows_) in enumerate(zip(trees, own.cut(vectors))):
                nearest, distance = tree.nearest(rows_)
                code[:, part] = nearest
                error += distance
            text = [each.tobytes().hex() for each in code]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "vec").mapInArrow(codes, f"vec_id bigint, label {label}, code string, error bigint")


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from (vec_id, vec); entry numbers are a byte, so ``entries`` is at most 256."""
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books is not None and books.entries.shape[1] else 0):
        books = moved(rows.where(F.size("vec") == books.length), books)
    return books


def compressed(table: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row of ``table`` that takes part.

    ``label_error`` is the error of all rows of the same label; rows without label are one group. Scaled vectors are written
    once, and read by every round.
    """
    rows = written(prepared(table, scale), "vectors")
    books = fit(rows, parts, entries, rounds)
    if books is None or not books.entries.shape[1]:
        label = rows.schema["label"].dataType.simpleString()
        return table.sparkSession.createDataFrame(
            [], f"vec_id bigint, label {label}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    found = written(coded(rows.where(F.size("vec") == books.length), books), "codes")
    return with_label_error(found).withColumn("codebooks_sha256", F.lit(books.digest()))


def with_label_error(found: DataFrame) -> DataFrame:
    """Labels are few as a rule and sent around; where they are not, Spark shuffles and splits the join."""
    total = found.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    same: Column = F.col("l.label").eqNullSafe(F.col("r.label"))
    return found.alias("l").join(sized(total).alias("r"), same, "left").select("l.*", "r.label_error")


assert 4 * LIMIT**2 * 1_024 < 1 << 63  # squared distances over thousands of components fit
