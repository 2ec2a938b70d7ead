import math

import numpy as np
import pytest

from logspark.llm import hard_negatives as hn
from logspark.llm.queries import QUERIES


def brute(rows, every=50, positives=5, negatives=3):
    good = sorted({(i, tuple(math.floor(256 * float(x)) for x in v), label) for i, v, label in rows
                   if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    found = []
    for a, q, own in good:
        if a % every:
            continue
        scored = {(i, label == own, sum(x * y for x, y in zip(q, v))) for i, v, label in good if i != a and len(v) == len(q)}
        best = sorted((-s, i) for i, same, s in scored if same)[:positives]
        for low, p in best:
            ps = -low
            others = sorted((-s, i) for i, same, s in scored if not same and 50 * ps <= 100 * s <= 95 * ps)[:negatives]
            found += [(a, p, n + 1, i, ps, -s) for n, (s, i) in enumerate(others)]
    return sorted(found)


def answer(df):
    return sorted(tuple(r) for r in df.collect())


def relabelled(rows):
    return [(i, v, (label + 1) % 10 if label is not None and i % 7 == 0 else label) for i, v, label in rows]


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = answer(QUERIES["op12_hard_negatives"](spark, folder))
    assert got == brute(relabelled(rows)) and len(got) > 50


@pytest.mark.parametrize("size", [3, 64, 100])
def test_intervals_hold(size):
    """No pair whose score lies in the range is lost, and far ones go."""
    rng = np.random.default_rng(size)
    vectors, queries = rng.integers(-200, 200, (500, size)), rng.integers(-200, 200, (40, size))
    vectors[:40] = queries + rng.integers(-9, 9, queries.shape)
    rotation = hn.Rotation.of(size)
    codes, align, left = hn.one_bit(rotation(vectors))
    assert (left[:, 1:] <= left[:, :-1]).all()
    asked = hn.Asked.of(rotation(queries))
    score = vectors @ queries.T
    low, high = 0.5 * (queries**2).sum(1), 1.1 * (queries**2).sum(1)
    row, anchor = hn.survivors(asked, codes, align, left, np.ones(score.shape, bool), low, high)
    kept = np.zeros(score.shape, bool)
    kept[row, anchor] = True
    assert not ((score >= low) & (score <= high) & ~kept).any()
    if size > 3:
        assert kept.mean() < 0.2


@pytest.mark.parametrize(("block_bytes", "sample_rows"), [(1 << 20, 50_000), (2_000, 60)])
def test_ties_copies_and_blocks(spark, block_bytes, sample_rows):
    rng = np.random.default_rng(1)
    rows = [(n, [float(x) for x in rng.integers(-3, 4, 5) / 8], int(rng.integers(0, 3))) for n in range(400)]
    rows += [(1000 + n, [0.25] * 5, n % 2) for n in range(200)] + rows[:20]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    given = hn.prepared(df)
    got = hn.mined(given, given.where("vec_id % 50 = 0"), block_bytes=block_bytes, sample_rows=sample_rows)
    assert answer(got) == brute(rows)


def test_nulls_lengths_and_clashing_names(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 2), (4, [float("inf"), 1.0], 2),
            (None, [9.0, 9.0], 1), (5, [], 2), (6, [1.0, 1.0], 1), (7, [1.0, 0.5], 2), (8, [2.0, 1.0], None), (9, [0.0, 1.2], 3),
            (50, [], 2), (51, [], 1), (100, [5.0], 4), (101, [4.0], 4), (102, [2.5], 5), (150, [0.0, 0.0], 3)]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows],
                               "vec_id bigint, embedding array<double>, label int, code string, slot int")
    given = hn.prepared(df)
    anchors = given.where("vec_id % 50 = 0")
    assert answer(hn.mined(given, anchors)) == brute(rows)
    assert answer(hn.mined(given.limit(0), anchors)) == [] == answer(hn.mined(given, anchors.limit(0)))
