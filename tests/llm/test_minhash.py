import random
import re
from itertools import combinations

import pytest

import corpus_pipeline
from brute import messy, roots
from logspark.llm import minhash, simhash


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower()) or (text or "").lower().split()
    return frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, threshold=0.8):
    """Smallest doc_id of each group, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a, b in combinations(sets, 2)
             if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    return set(roots(sorted(sets), edges).values())


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_drops_edited_copies(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 40, 200, 900]))]
        rows.append((len(rows), " ".join(words)))
        for share in (0, 0.005, 0.01, 0.02, 0.03):
            rows.append((len(rows), edited(rng, words, round(share * len(words)))))
    rows += [(9000, None), (9001, ""), (9002, "!!!"), (9003, "???")]
    want = brute(rows)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, messy(spark, rows), "").collect()}
    assert got == want and len(want) < 150


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in minhash.one_of_each(docs).collect()} == want


@pytest.fixture
def pairs_compared(monkeypatch):
    """Numbers of pairs whose shingles were compared."""
    counts, plain = [], minhash._similar
    monkeypatch.setattr(minhash, "_similar", lambda pairs, *rest: counts.append(pairs.count()) or plain(pairs, *rest))
    return counts


def test_large_group_of_near_copies_in_linear_many_pairs(spark, pairs_compared):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(200)]
    rows = [(n, edited(rng, words, 2)) for n in range(600)] + [(1000, "x " + " ".join(f"v{n}" for n in range(50)))]
    assert {r.doc_id for r in minhash.one_of_each(messy(spark, rows)).collect()} == brute(rows) == {0, 1000}
    assert sum(pairs_compared) < 600 * 100


@pytest.mark.parametrize("shared", [450, 520])
def test_no_class_is_parted_within_a_crowd(spark, pairs_compared, shared):
    """Texts that share most of their words, and so their keys, without being similar; some have a close copy."""
    rng = random.Random(shared)
    common = [f"c{n}" for n in range(shared)]
    rows = []
    for n in range(300):
        words = common + [f"u{n}x{k}" for k in range(600 - shared)]
        rows.append((2 * n, " ".join(words)))
        if n % 3 == 0:
            rows.append((2 * n + 1, edited(rng, words, 8)))
    rng.shuffle(rows)
    want = brute(rows)
    assert {r.doc_id for r in minhash.one_of_each(messy(spark, rows)).collect()} == want and len(want) < len(rows)
    assert len(pairs_compared) > 1  # the crowd was met


def test_links_of_any_length_hold_a_crowd_together(spark):
    """A chain: neighbours are similar, ends are not."""
    words = [f"w{n}" for n in range(400)]
    rows = []
    for n in range(120):
        words = words[:]
        for k in range(3):
            words[(7 * n + 131 * k) % 400] = f"n{n}k{k}"
        rows.append((n, " ".join(words)))
    assert {r.doc_id for r in minhash.one_of_each(messy(spark, rows)).collect()} == brute(rows) == {0}


def test_simhash_finds_candidates_of_its_own(spark, monkeypatch):
    """Without MinHash, what SimHash has within 4 bits and what is similar goes all the same."""
    rng = random.Random(6)
    rows = []
    for n in range(30):
        words = [f"t{n}w{k}" for k in range(400)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, edited(rng, words, 1 + n % 8))]
    rows += [(100, ""), (101, None)]
    fps = {i: simhash.fingerprint(t or "", minhash.WORDS) for i, t in rows}
    near = [(i, i + 1) for i in range(0, 60, 2) if (fps[i] ^ fps[i + 1]).bit_count() <= 4] + [(100, 101)]

    def none(classes):
        return [spark.createDataFrame([], schema) for schema in ("a bigint, b bigint", "key bigint, id bigint")]

    monkeypatch.setattr(minhash, "candidates", none)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, messy(spark, rows), "").collect()}
    assert got == {i for i, _ in rows} - {b for _, b in near} and len(near) > 2


def test_a_crowd_is_looked_up_by_few_of_its_shingles(spark, monkeypatch):
    rng = random.Random(7)
    common, rows, looked_up, plain = [f"c{n}" for n in range(260)], [], [], minhash.written
    for n in range(200):
        words = common + [f"u{n}x{k}" for k in range(40)]
        rows.append((2 * n, " ".join(words)))
        if n % 4 == 0:
            rows.append((2 * n + 1, edited(rng, words, 3)))

    def written(df, name="staged"):
        out = plain(df, name)
        if name == "first":
            looked_up.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", written)
    want = brute(rows)
    assert {r.doc_id for r in minhash.one_of_each(messy(spark, rows)).collect()} == want and len(want) < len(rows)
    assert len(looked_up) == 1 and 0 < looked_up[0] <= 0.25 * sum(len(shingles(t)) for _, t in rows)


def test_what_a_crowd_has_in_common_makes_no_pairs(spark, pairs_compared):
    """Copies of one text, edited too much to be similar: only those that differ from it in the same are compared."""
    rng = random.Random(8)
    words, rows = [f"w{n}" for n in range(150)], []
    for n in range(300):
        rows.append((2 * n, edited(rng, words, 3)))
        if n % 10 == 0:
            rows.append((2 * n + 1, edited(rng, rows[-1][1].split(), 2)))
    want = brute(rows)
    assert {r.doc_id for r in minhash.one_of_each(messy(spark, rows)).collect()} == want and 100 < len(want) < len(rows)
    assert len(pairs_compared) > 2 and pairs_compared[-1] <= 10 * len(rows), pairs_compared


def test_differences_find_every_similar_pair_of_a_crowd(spark):
    """Whatever the sizes: also those that differ from the example in nothing, or in all."""
    rng = random.Random(9)
    base, sets = list(range(1, 101)), {}
    for n in range(150):
        kept = rng.sample(base, rng.choice([60, 80, 90, 95, 100]))
        sets[n] = sorted(kept + [1000 + rng.randrange(40) for _ in range(rng.choice([0, 0, 3, 10, 25, 60]))])
        sets[n] = sorted(set(sets[n]))
    sets[150], sets[151], sets[152] = list(range(5000, 5020)), list(range(5001, 5020)), base
    found = minhash._prefixes(spark.createDataFrame(list(sets.items()), "id bigint, shingles array<bigint>"), spark.createDataFrame(
        [(n, 152) for n in sets], "id bigint, a bigint"), 0.8).collect()
    held = {}
    for r in found:
        held.setdefault(r.shingle, []).append(r)
    met = {(min(x.id, y.id), max(x.id, y.id)) for g in held.values() for x, y in combinations(g, 2)
           if x.differing + y.differing - 2 * min(x.rest, y.rest) <= (x.size + y.size) / 9 + 1e-6}
    similar = {(a, b) for a, b in combinations(sets, 2)
               if 10 * len(set(sets[a]) & set(sets[b])) >= 8 * len(set(sets[a]) | set(sets[b]))}
    assert similar <= met and len(similar) > 100 and any(152 in p for p in similar) and (150, 151) in similar
