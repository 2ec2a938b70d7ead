import hashlib
import math
import struct

import numpy as np
import pytest

from logspark.llm import quantizer
from logspark.llm.queries import QUERIES


def floats(values):
    """As a table of floats holds them."""
    return [struct.unpack("f", struct.pack("f", x))[0] for x in values]


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(vec_id, code, error, label_error, digest) by comparing everything, for (vec_id, vector, label)."""
    good = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(good[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in good]
    first = {}
    for (i, v, _), own in zip(good, cut):
        if i is not None and (i not in first or v < first[i][0]):
            first[i] = (v, own)
    start = [first[i][1] for i in sorted(first)[:entries]]
    books = [[own[p] for own in start] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for own in cut:
                held.setdefault(nearest(p, own[p])[1], []).append(own[p])
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else entry for e, entry in enumerate(books[p])]
    final = [[nearest(p, own[p]) for p in range(parts)] for own in cut]
    errors = [sum(d for d, _ in own) for own in final]
    by_label = {}
    for (_, _, label), error in zip(good, errors):
        by_label[label] = by_label.get(label, 0) + error
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in own), error, by_label[label], digest)
                   for (i, _, label), own, error in zip(good, final, errors)), key=repr)


def answer(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["ties", "spread", "copies", "large"])
def test_tree_finds_what_comparing_everything_finds(kind):
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 100, 256):
        most = {"ties": 4, "spread": 600, "copies": 3, "large": 1 << 20}[kind]
        entries = rng.integers(-most, most + 1, (n, 4))
        if kind == "copies":
            entries = np.repeat(entries, 3, axis=0)[:n]
        rows = np.vstack([rng.integers(-most, most + 1, (300, 4)), entries])
        distance = ((rows[:, None] - entries[None]) ** 2).sum(-1)
        index, least = quantizer.Gnat(entries).nearest(rows)
        assert (index == distance.argmin(1)).all() and (least == distance.min(1)).all()


def test_tree_leaves_subtrees_out():
    rng = np.random.default_rng(5)
    entries = np.repeat(rng.integers(-5_000, 5_000, (32, 4)), 8, axis=0) + rng.integers(-40, 40, (256, 4))
    tree = quantizer.Gnat(entries)
    tree.nearest(entries[rng.integers(0, 256, 1_000)] + rng.integers(-40, 40, (1_000, 4)))
    assert tree.compared < 0.5 * 256 * 1_000


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert answer(QUERIES["op11_vector_codes"](spark, folder)) == brute(rows)


def test_ties_copies_nulls_and_clashing_names(spark):
    rng = np.random.default_rng(7)
    rows = [(n, floats(rng.integers(-3, 4, 8) / 8), n % 3 if n % 5 else None) for n in range(300)]
    rows += [(1000 + n, [0.25] * 8, 1) for n in range(100)] + [(3, rows[3][1], 0), (3, [-9.0] * 8, 0), (None, [0.5] * 8, 2)]
    bad = [(7, None, 1), (8, [None] * 8, 1), (9, [float("nan")] * 8, 2), (10, [float("inf")] + [1.0] * 7, None)]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows + bad],
                               "vec_id bigint, embedding array<float>, label int, vec string, place int")
    assert answer(quantizer.compressed(df)) == brute(rows + bad)
    # The partitioning plays no part.
    assert answer(quantizer.compressed(df.repartition(7))) == brute(rows + bad)


def test_lengths_limits_and_empty_tables(spark):
    rows = [(1, [1.0] * 6, "a"), (2, [1e30] * 6, "a"), (3, [2.0] * 6, None), (4, [1.0], "b"), (5, [], "b")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    got = quantizer.compressed(df)
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == [(1, "00000000", 0), (2, "01010100", 0), (3, "02020200", 0)]  # the last part is filled up
    assert got.schema["label"].dataType.simpleString() == "string"
    for nothing in (df.limit(0), df.where("vec_id > 9"), df.withColumn("vec_id", df["vec_id"] * None).where("label = 'a'")):
        empty = quantizer.compressed(nothing)
        assert empty.collect() == [] and empty.columns[:3] == ["vec_id", "label", "code"]
    only = quantizer.compressed(df.where("vec_id = 5")).collect()
    assert [(r.vec_id, r.code, r.error) for r in only] == [(5, "00000000", 0)]
