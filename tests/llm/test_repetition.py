import re
import time

import numpy as np
import pytest

from brute import messy
from logspark.llm import repetition
from logspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def depths(words):
    """Words of the longest passage that starts at each place and at another."""
    found = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best = max(best, n)
        found.append(best)
    return found


def inside(words, size):
    """Places in windows of ``size`` words that stand twice or more."""
    at = {}
    for i in range(len(words) - size + 1):
        at.setdefault(tuple(words[i:i + size]), []).append(i)
    return {i + k for places in at.values() if len(places) > 1 for i in places for k in range(size)}


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(inside(words, 3)), len(inside(words, 5)), bool(inside(words, 101)))


def test_suffix_arrays_against_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(120):
        texts = [rng.integers(0, rng.choice([1, 2, 5, 40]), rng.integers(0, 40)).tolist() for _ in range(4)]
        texts[1] = texts[1] * (1 + trial % 3)
        owner = np.repeat(np.arange(4), [len(t) for t in texts])
        words = np.array(sum(texts, []), np.int64)
        assert repetition.longest_repeats(owner, words).tolist() == sum([depths(t) for t in texts], [])
        order, lcp = repetition.suffix_array(owner, words)
        ends = np.cumsum([len(t) for t in texts])
        suffixes = [(int(owner[i]), words[i:ends[owner[i]]].tolist()) for i in order]
        assert suffixes == sorted(suffixes) and len(lcp) == len(words)


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op13_quality"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, lines, repeated, covered, long = brute(rows[r.doc_id])
        failed = n < 50 or 100 * repeated > 50 * n
        assert tuple(r) == (r.doc_id, n, chars, symbols, lines, repeated, failed, not (
            failed or 100 * covered > 30 * n or long), covered)
    assert 0 < sum(not r.kept for r in got) < len(got) / 2


def test_spans_and_verdicts(spark):
    unique = " ".join(f"w{n}" for n in range(300))
    passage = " ".join(f"p{n}" for n in range(101))
    texts = {1: unique, 2: f"{passage} {unique} {passage}", 3: f"{unique} a b c d e x a b c d e", 4: "a b " * 40, 5: "too short",
             6: " ".join(f"p{n}" for n in range(100)) + f" {unique} " + " ".join(f"p{n}" for n in range(100))}
    got = {r.doc_id: r for r in repetition.judged(messy(spark, texts.items(), "longest")).collect()}
    assert [(r.doc_id, r.base_failed, r.kept) for _, r in sorted(got.items())] == [
        (1, False, True), (2, False, False), (3, False, True), (4, True, False), (5, True, False), (6, False, False)]
    assert [tuple(s) for s in got[2].repeats] == [(0, 101), (401, 502)] and got[2].longest == 101
    assert [tuple(s) for s in got[3].repeats] == [(300, 305), (306, 311)]
    assert (got[6].longest, got[6].covered) == (100, 200)
    assert [tuple(s) for s in got[4].repeats] == [(0, 80)] and got[1].repeats == []


@pytest.mark.parametrize("text", [None, "", " \n\t ", "x", "é ü é ü", "\x1c\x1d a \x0b b", "a\r\nb\na\r\n\n\n", "日本 🎈 <|>"])
def test_odd_texts(spark, text):
    docs = messy(spark, [(1, text), (1, text), (None, text)], "covered")
    got = repetition.measured(docs).collect()
    assert len(got) == 3
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)[:5]
    assert repetition.judged(docs.limit(0)).collect() == []


def test_long_texts_take_little_time():
    rng = np.random.default_rng(2)
    for text in (b"same words " * 100_000, b" ".join(b"%d" % n for n in rng.integers(0, 50_000, 200_000)),
                 b" ".join(b"%d" % n for n in range(50_000)) * 4, b"line\n" * 200_000):
        start = time.perf_counter()
        repetition.measure([text], repetition.Rules())
        assert time.perf_counter() - start < 20
