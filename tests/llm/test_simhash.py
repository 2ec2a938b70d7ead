import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brute import messy, roots
from logspark.llm import simhash
from logspark.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, distance=4):
    nodes = sorted(set(fps))
    edges = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if (a ^ b).bit_count() <= distance]
    return roots(nodes, edges)


def test_fingerprint_matches_its_definition():
    for text in ("", " \t\n", "One", "a B c", "É a\x0bb\x1cc d e", "x y z w " * 40, "ünï cödé " * 3 + "tail"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**64, 400, dtype=np.uint64)
    other = fps.copy()
    for n in range(len(fps)):
        for bit in rng.choice(64, n % 5, replace=False):
            other[n] ^= np.uint64(1 << int(bit))
    left, right = ({}, {})
    for found, given in ((left, fps), (right, other)):
        row, key = simhash.golay_keys(given)
        for r, k in zip(row, key):
            found.setdefault(r, set()).add(k)
    assert all(left[n] & right[n] for n in range(len(fps)))
    assert max(len(k) for k in left.values()) < 200


@pytest.mark.parametrize("bucket", [1, 3, 48])
def test_components_of_planted_clusters(spark, bucket):
    rng = np.random.default_rng(bucket)
    fps = [int(x) for x in rng.integers(0, 2**64, 30, dtype=np.uint64)]
    for start in fps[:4]:
        for _ in range(25):
            walk = start
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                walk ^= 1 << int(bit)
            fps.append(walk)
            start = walk if rng.random() < 0.5 else start
    signed = [int(np.uint64(x).view(np.int64)) for x in set(fps)]
    classes = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = simhash.links(classes, most=bucket)
    got = {r.node: r.root for r in components(edges).collect()}
    want = brute_roots([x & (2**64 - 1) for x in signed])
    groups = {}
    for x in signed:
        groups.setdefault(want[x & (2**64 - 1)], set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({got.get(x, x) for x in signed})


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    by_fp = brute_roots(fps.values())
    lowest = {}
    for i, fp in fps.items():
        lowest[by_fp[fp]] = min(i, lowest.get(by_fp[fp], i))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{fp:016x}", lowest[by_fp[fp]]) for i, fp in fps.items())


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(3, None), (2, ""), (7, "a b c d e"), (7, "a b c d e"), (None, "A b c d e"), (9, "other words stand here")]
    got = simhash.near_duplicates(messy(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 7), (2, 2), (3, 2), (7, 7), (7, 7), (9, 9)]
    assert simhash.near_duplicates(messy(spark, rows).limit(0)).collect() == []


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).collect() == []
