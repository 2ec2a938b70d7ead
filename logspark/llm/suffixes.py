"""Repeated passages across documents by a sparse suffix array.

A text is its words, split at white space. Of all suffixes only those are kept that start at a content-selected
place: the smallest of every ``WINDOW`` neighbouring word runs of ``RUN`` words by hash (minimisers). Wherever the same
passage stands, the same places in it are kept, so a passage of ``least`` = 50 words has a kept suffix
among its first 25 words, of which at least 26 words (``HEAD``) still lie in the passage.

1. Equal texts are one entry: the whole text is repeated, and only the copy of the smallest doc_id goes on.
2. Suffixes whose head occurs in one document only are dropped: heads are counted, combined before the shuffle, and joined back
   in a way Spark may split where a head is frequent.
3. The suffixes left are given their surroundings from the text: 24 words on either side of the head, as hashes of 4 bytes.
4. They are sorted by head and what follows, spread over tasks by the full key, so that a passage which a third of all
   documents share is many tasks' work. Each is compared with its ``NEAR`` neighbours on either side, of other documents, and the
   match is extended word by word to the right and to the left; 50 words or more are a find.
5. A head with more suffixes than that may have a pair that the order parted. Where one of its suffixes has windows of 50 words
   that no neighbour shares, the head is looked through by other means: each suffix names the windows of 50 words that it was
   selected for (13 on average; every window has one such suffix, by its content), and a window named by two
   documents is a find.
6. Finds of a document that touch are joined to passages of any length.

Cases: null, empty and short texts have no passage; a passage repeated within one document only is none; repeated rows of
one doc_id count as one document; rows without doc_id are left out; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.llm.common import texts
from logspark.session import written

LEAST = 50
RUN = 8
WINDOW = 25
HEAD = LEAST - WINDOW + 1
#: Words looked at on either side of the head: with it they make up ``LEAST``.
SIDE = LEAST - HEAD
#: Neighbours on either side in the order that a suffix is compared with.
NEAR = 48
#: Different words whose hashes one Python worker keeps; when full, the memory starts anew.
MEMORY_WORDS = 600_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MEMORY: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.split()
    new = [word for word in set(words) if word not in _MEMORY]
    if new:
        if len(_MEMORY) + len(new) > MEMORY_WORDS:
            _MEMORY.clear()
            new = list(set(words))
        _MEMORY.update((word, xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7) | 1) for word in new)
    return np.array([_MEMORY[word] for word in words], np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _B
    return values ^ (values >> np.uint64(29))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, by joining two shorter ones (which may overlap)."""
    out, have = hashes, 1
    while have < size:
        step = min(have, size - have)
        out = mixed(out[:len(out) - step] * _A + out[step:])
        have += step
    return out


def kept_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the kept suffixes that have a whole head, and how many words before each the first and
    the last window begins that it was selected for."""
    if len(hashes) < LEAST:
        return (np.empty(0, np.int64),) * 3
    every = np.lib.stride_tricks.sliding_window_view(runs(hashes, RUN), WINDOW)
    places, first, count = np.unique(every.argmin(1) + np.arange(len(every)), return_index=True, return_counts=True)
    whole = places + HEAD <= len(hashes)
    return places[whole], (places - first)[whole], (places - first - count + 1)[whole]


def suffixes(docs: DataFrame) -> DataFrame:
    """(head, doc_id, place) of all kept suffixes, and per text of ``LEAST`` words or more a row whose place is
    its number of words, negative."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, ids, places = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = word_hashes(text.as_py())
                if len(hashes) < LEAST:
                    continue
                own = kept_places(hashes)[0]
                heads.append(np.append(runs(hashes, HEAD)[own], np.uint64(0)))
                ids.append(np.full(len(own) + 1, doc_id, np.int64))
                # The last row of each text gives its length.
                places.append(np.append(own, -len(hashes)))
            if heads:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.concatenate(ids)),
                    pa.array(np.concatenate(places).astype(np.int32))], ["head", "doc_id", "place"])

    return texts(docs).where("doc_id is not null").mapInArrow(run, "head bigint, doc_id bigint, place int")


def with_surroundings(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(head, after, before, doc_id, place, far, near): word hashes to the right of the head and to its left (nearest
    first), 4 bytes each, 0 beyond the text; ``far`` and ``near`` as in :func:`kept_places`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(SIDE)
        for batch in batches:
            for doc_id, text, own in zip(*(batch.column(n) for n in range(3))):
                hashes = word_hashes(text.as_py())
                kept, far, near = kept_places(hashes)
                which = np.isin(kept, np.asarray(own.values))
                own, far, near = kept[which], far[which], near[which]
                if not len(own):
                    continue
                short = ((mixed(hashes) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)
                padded = np.concatenate([np.zeros(SIDE, np.uint32), short, np.zeros(SIDE, np.uint32)])
                after = padded[SIDE + own[:, None] + HEAD + at]
                before = padded[SIDE + own[:, None] - 1 - at]
                yield pa.RecordBatch.from_arrays([
                    pa.array(runs(hashes, HEAD)[own].view(np.int64)),
                    pa.array([row.tobytes() for row in after], pa.binary()),
                    pa.array([row.tobytes() for row in before], pa.binary()),
                    pa.array(np.full(len(own), doc_id.as_py(), np.int64)), pa.array(own.astype(np.int32)),
                    pa.array(far.astype(np.int8)), pa.array(near.astype(np.int8)),
                ], ["head", "after", "before", "doc_id", "place", "far", "near"])

    joined = texts(docs).join(places, "doc_id").select("doc_id", "text", "places")
    return joined.mapInArrow(run, "head bigint, after binary, before binary, doc_id bigint, place int, far tinyint, near tinyint")


def _sides(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), SIDE)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that two rows of surroundings share from their near end on."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), SIDE, same.argmin(1))


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finds among rows sorted by (head, after): (head, doc_id, start, stop, other); a row with a null stop marks a
    suffix that has more neighbours than it was compared with, and windows it was selected for that none of those shares.

    What is kept between batches are twice ``NEAR`` + 1 rows.
    """
    reach = NEAR + 1
    rows: dict[str, np.ndarray] = {}
    done, first = 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {"head": np.asarray(batch.column(0)), "after": _sides(batch.column(1)), "before": _sides(batch.column(2)),
               "doc": np.asarray(batch.column(3)), "place": np.asarray(batch.column(4)).astype(np.int64),
               "far": np.asarray(batch.column(5)).astype(np.int64), "near": np.asarray(batch.column(6)).astype(np.int64),
               "mask": np.zeros(batch.num_rows, np.int64), "other": np.full(batch.num_rows, np.iinfo(np.int64).max)}
        rows = {k: np.concatenate([rows[k], v]) for k, v in new.items()} if rows else new
        _compare(rows, reach - 1)
        count = len(rows["head"])
        if count - reach > done:
            yield from _results(rows, done, count - reach, reach, first, False)
            cut = max(0, count - 2 * reach)
            rows = {k: v[cut:] for k, v in rows.items()}
            first, done = first and cut == 0, count - reach - cut
    if rows and len(rows["head"]) > done:
        yield from _results(rows, done, len(rows["head"]), reach, first, True)


def _compare(rows: dict[str, np.ndarray], near: int) -> None:
    """Note in ``mask`` which windows a neighbour shares: bit n is the window that starts n words before the head."""
    head, doc = rows["head"], rows["doc"]
    for step in range(1, near + 1):
        a = np.flatnonzero(head[step:] == head[:-step])
        if not len(a):
            return
        a = a[doc[a] != doc[a + step]]
        b = a + step
        left, right = common(rows["before"][a], rows["before"][b]), common(rows["after"][a], rows["after"][b])
        enough = left + right >= SIDE
        a, b, left, right = a[enough], b[enough], left[enough], right[enough]
        bits = ((1 << (left + 1)) - 1) & ~((1 << (SIDE - right)) - 1)
        for own, partner in ((a, b), (b, a)):
            rows["mask"][own] |= bits
            rows["other"][own] = np.minimum(rows["other"][own], doc[partner])


def _results(
    rows: dict[str, np.ndarray], start: int, stop: int, reach: int, at_start: bool, at_end: bool,
) -> Iterator[pa.RecordBatch]:
    head = rows["head"]
    at = np.arange(start, stop)
    # Beyond the rows at hand lies another task, or nothing.
    more = np.zeros(len(at), bool)
    inner = at >= reach
    more[inner] |= head[at[inner] - reach] == head[at[inner]]
    inner = at + reach < len(head)
    more[inner] |= head[at[inner] + reach] == head[at[inner]]
    if at_start:
        more |= head[at] == head[0]
    if at_end:
        more |= head[at] == head[-1]
    there = [(rows[side][start:stop] != 0).sum(1) for side in ("before", "after")]
    far = np.minimum(there[0], rows["far"][start:stop])
    near = np.maximum(SIDE - there[1], rows["near"][start:stop])
    wanted = np.where(far >= near, ((1 << (far + 1)) - 1) & ~((1 << np.maximum(near, 0)) - 1), 0)
    mask = rows["mask"][start:stop].copy()
    marked = at[more & ((mask & wanted) != wanted)]
    nothing = [None] * len(marked)
    yield _find(head[marked], rows["doc"][marked], rows["place"][marked], nothing, nothing)
    while (has := np.flatnonzero(mask)).size:
        low = mask[has] & -mask[has]
        run = mask[has] & ~(mask[has] + low)
        mask[has] &= ~run
        nearest, farthest = np.log2(low).astype(np.int64), np.log2(run).astype(np.int64)
        own = at[has]
        yield _find(head[own], rows["doc"][own], rows["place"][own] - farthest, rows["place"][own] - nearest + LEAST,
                    rows["other"][own])


def _find(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)],
                                      ["head", "doc_id", "start", "stop", "other"])


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, doc_id, start): hashes of the runs of ``LEAST`` words that each suffix was selected for."""
    for batch in batches:
        head = np.asarray(batch.column(0)).view(np.uint64)
        after, before = _sides(batch.column(1)), _sides(batch.column(2))
        doc, place, far, near = (np.asarray(batch.column(n)) for n in range(3, 7))
        lefts, rights = [np.zeros(len(head), np.uint64)], [head.copy()]
        for n in range(SIDE):
            lefts.append(mixed(lefts[-1] * _A + before[:, n].astype(np.uint64) + np.uint64(1)))
            rights.append(mixed(rights[-1] * _A + after[:, n].astype(np.uint64) + np.uint64(1)))
        for left in range(SIDE + 1):
            whole = (near <= left) & (left <= far)
            if left:
                whole &= before[:, left - 1] != 0
            if left < SIDE:
                whole &= after[:, SIDE - left - 1] != 0
            key = mixed(lefts[left] * _B + rights[SIDE - left] + np.uint64(left))
            yield pa.RecordBatch.from_arrays([
                pa.array(key[whole].view(np.int64)), pa.array(doc[whole]),
                pa.array((place[whole] - left).astype(np.int32))], ["window", "doc_id", "start"])


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, words, other): passages, in words of the text, that another document has too.

    ``other`` is the smallest doc_id that was found to share part of it.
    """
    every = written(suffixes(docs), "suffixes")
    lengths = every.where("place < 0").groupBy("doc_id").agg((-F.min("place")).cast("int").alias("stop"))
    # Documents with one text, by that text; others go through as they are.
    prints = texts(docs).where("doc_id is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text")).groupBy(
        "doc_id").agg(F.min("text").alias("text"), F.max("text").alias("_last")).where("text = _last").drop("_last")
    # What is counted by a key is written before it is joined back by it: only then can Spark split a frequent key.
    equal = written(prints.groupBy("text").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b"), "equal")
    copies = written(prints.join(equal, "text").select("doc_id", "_a", "_b"), "copies")
    whole = copies.join(lengths, "doc_id").select(
        "doc_id", F.lit(0).alias("start"), "stop", F.when(F.col("doc_id") == F.col("_a"), F.col("_b")).otherwise(
            F.col("_a")).alias("other"))

    kept = every.where("place >= 0").join(copies.where("doc_id > _a").select("doc_id"), "doc_id", "left_anti")
    shared = written(kept.groupBy("head").agg(
        F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b").select("head"), "heads")
    places = kept.join(shared, "head", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    around = written(with_surroundings(docs, places), "around")

    key = ["head", "after", "doc_id", "place"]
    ordered = around.repartitionByRange(*key).sortWithinPartitions(*key)
    compared = written(ordered.mapInArrow(
        compare_neighbours, "head bigint, doc_id bigint, start int, stop int, other bigint"), "compared")
    finds = compared.where("stop is not null").select("doc_id", "start", "stop", "other").unionByName(whole)

    open_heads = compared.where("stop is null").select("head").distinct()
    rest = around.join(open_heads, "head", "left_semi").select(*around.columns)
    named = written(rest.mapInArrow(windows, "window bigint, doc_id bigint, start int"), "windows")
    both = written(named.groupBy("window").agg(
        F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b"), "shared")
    more = named.join(both, "window").select(
        "doc_id", "start", (F.col("start") + LEAST).alias("stop"),
        F.when(F.col("doc_id") == F.col("_a"), F.col("_b")).otherwise(F.col("_a")).alias("other"))

    # A window of one document's finds: as long as its text.
    found = finds.unionByName(more).groupBy("doc_id", "start").agg(F.max("stop").alias("stop"), F.min("other").alias("other"))
    own = W.partitionBy("doc_id").orderBy("start")
    reach = F.max("stop").over(own.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    numbered = found.withColumn("_opens", opens).withColumn("_n", F.sum("_opens").over(own))
    return numbered.groupBy("doc_id", "_n").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("other").alias("other")).select(
        "doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("words"), "other")
