import math

import numpy as np
import pytest

from logspark.llm import topk
from logspark.llm.queries import QUERIES


def brute(rows, k=5, every=50):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, set()).add(tuple(math.floor(256 * float(x)) for x in v))
    found = []
    for q in sorted(good):
        if q % every:
            continue
        scores = {}
        for own in good[q]:
            for i, vectors in good.items():
                for v in vectors:
                    if i != q and len(v) == len(own):
                        scores[i] = max(scores.get(i, -10**18), sum(a * b for a, b in zip(own, v)))
        order = sorted(scores, key=lambda i: (-scores[i], i))[:k]
        found += [(q, n + 1, i, scores[i]) for n, i in enumerate(order)]
    return found


def answer(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert answer(QUERIES["op10_topk"](spark, folder)) == brute(rows)


@pytest.mark.parametrize(("bits", "at_once"), [(1, 3), (4, 100)])
def test_ties_copies_and_blocks(spark, bits, at_once):
    rng = np.random.default_rng(bits)
    rows = [(n, [float(x) for x in rng.integers(-3, 4, 4) / 8]) for n in range(300)]
    rows += [(1000 + n, [0.25, 0.25, 0.25, 0.25]) for n in range(100)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    given = topk.prepared(docs)
    got = answer(topk.search(given, given.where("vec_id % 50 = 0"), bits=bits, at_once=at_once))
    assert got == brute(rows)


def test_nulls_repeats_lengths_and_clashing_names(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (None, [9.0, 9.0]), (5, []), (6, [1.0, 1.0]), (50, [3.0]), (51, [2.0]), (100, [5.0, 5.0, 5.0]), (7, [-1.0, 0.5])]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, rep int, vec int")
    given = topk.prepared(docs)
    assert answer(topk.search(given, given.where("vec_id % 50 = 0"))) == brute(rows)
    nothing = given.limit(0)
    assert answer(topk.search(nothing, nothing)) == [] == answer(topk.search(nothing, given))
