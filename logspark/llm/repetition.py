"""Quality rules on repetition within a text, by suffix arrays.

The words of each text, runs of anything but ASCII white space, are put into a suffix array: the places of all words, in the
order of what follows from there. Two neighbours have a longest common prefix; neighbours that share at least l words are
an LCP interval, and what its suffixes share is a maximal repeat. The deepest interval a suffix lies in is as deep
as the larger of its two neighbouring prefixes, so each place knows the longest passage that starts there and stands
elsewhere in the same text too. The union of these spans, of those of ``min_words`` words or more, gives the part of the text
that is repeated (all occurrences, overlapping ones too), and the longest prefix the longest repeat. A text fails when
over ``max_percent`` of its words are covered or when a repeat is longer than ``max_longest`` words.

The arrays are built by prefix doubling in numpy for many texts at once: classes of equal runs of 1, 2, 4 ... words, where
only places that still share a class are sorted again. A prefix is found by going down the classes. Time is
n log n in the words of a text and nothing is compared pairwise, however often a passage repeats. Texts never meet, so
there is no shuffle; texts of about ``CHUNK`` bytes are worked on together, and a longer one on its own.

Cases: a null text has no words, as an empty one; fewer than two words repeat nothing; each row gives one row, repeated
rows and rows without doc_id too; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import texts

#: Bytes of text that are worked on together.
CHUNK = 1 << 20
_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))

_COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered", "longest")
SCHEMA = ", ".join([*[f"{name} bigint" for name in _COUNTS], "repeats array<struct<start:bigint,end:bigint>>"])


@dataclass(frozen=True)
class Rules:
    """``window``: words of the windows that count as ``n_repeat_words``; a text of fewer than ``least_words`` words fails, as does
    one with over ``max_window_percent`` of its words in such windows. ``min_words``, ``max_percent`` and
    ``max_longest`` are the limits on maximal repeats."""

    window: int = 3
    least_words: int = 50
    max_window_percent: int = 50
    min_words: int = 5
    max_percent: int = 30
    max_longest: int = 100


def _classes(sorted_: np.ndarray) -> np.ndarray:
    """Where, in a sorted array of keys, the run of each entry begins."""
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _shared(rank: np.ndarray) -> np.ndarray:
    """Which entries of sorted ``rank`` are not alone in theirs."""
    same = rank[1:] == rank[:-1]
    return np.r_[same, False] | np.r_[False, same]


def suffix_array(owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, lcp)``: places sorted by owner and what follows within it, and the words each shares with the one before.

    ``owner`` does not fall; ``words`` are numbers. A suffix that ends comes before those that go on.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = owner.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    first = _classes(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = first
    ends = np.searchsorted(owner, owner, "right")
    active = order[_shared(first)]
    top = np.full(n + 1, -1, np.int8)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1
    while len(active):
        top[active] = len(levels)
        places = np.sort(active)
        levels.append((places, rank[places]))
        after = active + step
        follows = np.where(after < ends[active], rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((follows, rank[active]))
        active, follows = active[by], follows[by]
        old = rank[active]
        old_start, at = _classes(old), np.arange(len(active))
        new = np.r_[True, (old[1:] != old[:-1]) | (follows[1:] != follows[:-1])]
        start = np.maximum.accumulate(np.where(new, at, 0))
        fresh = old + start - old_start
        rank[active] = fresh
        active = active[_shared(fresh)]
        step *= 2
    order[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(key[a] == key[b])
    a, b, length = a[near], b[near], np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        places, classes = levels[level]
        left, right = np.minimum(a + length, n), np.minimum(b + length, n)
        may = np.flatnonzero((top[left] >= level) & (top[right] >= level))
        equal = classes[np.searchsorted(places, left[may])] == classes[np.searchsorted(places, right[may])]
        length[may[equal]] += 1 << level
    lcp[near + 1] = length
    return order, lcp


def longest_repeats(owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each place, the words of the longest passage that starts there and elsewhere in the same text."""
    order, lcp = suffix_array(owner, words)
    found = np.zeros(len(words), np.int64)
    found[order] = np.maximum(lcp, np.r_[lcp[1:], 0]) if len(lcp) else lcp
    return found


def _covered(depth: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a passage of ``least`` words or more."""
    starts = np.flatnonzero(depth >= least)
    change = np.zeros(len(depth) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + depth[starts], -1)
    return np.cumsum(change[:-1]) > 0


def _per_text(owner: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=count).astype(np.int64)


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines))


def measure(texts_: list[bytes], rules: Rules) -> list[np.ndarray | list]:
    """The columns of ``SCHEMA`` behind doc_id."""
    known: dict[bytes, int] = {}
    split = [text.split() for text in texts_]  # bytes are split at ASCII white space
    sizes = np.array([len(words) for words in split], np.int64)
    numbers = np.fromiter((known.setdefault(word, len(known)) for words in split for word in words), np.int64, int(sizes.sum()))
    del split, known
    count = len(texts_)
    owner = np.repeat(np.arange(count), sizes)
    depth = longest_repeats(owner, numbers)
    covered = _covered(depth, rules.min_words)
    longest = np.zeros(count, np.int64)
    np.maximum.at(longest, owner, depth)
    # Spans of places in a row, cut where a text ends.
    new = covered & np.r_[True, ~covered[:-1] | (owner[1:] != owner[:-1])] if len(covered) else covered
    last = covered & np.r_[~covered[1:] | (owner[1:] != owner[:-1]), True] if len(covered) else covered
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    begin = np.cumsum(sizes) - sizes
    spans: list[list[dict]] = [[] for _ in range(count)]
    for who, start, end in zip(owner[starts].tolist(), (starts - begin[owner[starts]]).tolist(), (ends - begin[owner[starts]]).tolist()):
        spans[who].append({"start": start, "end": end})
    return [
        sizes,
        np.array([len(text.translate(None, _SPACE + _CONTINUED)) for text in texts_], np.int64),
        np.array([len(text) - len(text.translate(None, _SYMBOLS)) for text in texts_], np.int64),
        np.array([_duplicate_lines(text) for text in texts_], np.int64),
        _per_text(owner, _covered(depth, rules.window), count),
        _per_text(owner, covered, count),
        longest,
        spans,
    ]


def measured(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``SCHEMA`` for every row of ``docs``: counts, and the union of the maximal repeats as spans of words."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = pa.schema([*[(name, pa.int64()) for name in _COUNTS], ("repeats", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            start, size, group = 0, 0, []
            for n in range(batch.num_rows + 1):
                text = column[n].as_py() if n < batch.num_rows else b""
                if group and (n == batch.num_rows or size + len(text) > CHUNK):
                    values = measure(group, rules)
                    yield pa.RecordBatch.from_arrays(
                        [ids[start:n], *[pa.array(v, kind.type) for v, kind in zip(values, list(kinds)[1:])]], schema=kinds)
                    start, size, group = n, 0, []
                group.append(text)
                size += len(text)

    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def base_failed(rules: Rules = Rules()) -> Column:
    return (F.col("n_words") < rules.least_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_window_percent)


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """:func:`measured` with ``base_failed`` and ``kept``."""
    repeats = (F.col("covered") * 100 > F.col("n_words") * rules.max_percent) | (F.col("longest") > rules.max_longest)
    return measured(docs, rules).withColumn("base_failed", base_failed(rules)).withColumn("kept", ~F.col("base_failed") & ~repeats)
