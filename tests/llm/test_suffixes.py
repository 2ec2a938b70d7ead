import numpy as np

from brute import messy
from logspark.llm import suffixes


def brute(rows, least=50):
    owners, words_of = {}, {}
    for n, (i, text) in enumerate(rows):
        if i is None:
            continue
        words = words_of[n] = (text or "").split()
        for at in range(len(words) - least + 1):
            owners.setdefault(" ".join(words[at:at + least]), set()).add(i)
    found = {}
    for n, words in words_of.items():
        i = rows[n][0]
        for at in range(len(words) - least + 1):
            if len(owners[" ".join(words[at:at + least])]) > 1:
                found.setdefault(i, set()).add(at)
    out = set()
    for i, starts in found.items():
        start = stop = None
        for at in sorted(starts):
            if stop is None or at > stop:
                if stop is not None:
                    out.add((i, start, stop))
                start = at
            stop = at + least
        out.add((i, start, stop))
    return out


def answer(df):
    return {(r.doc_id, r.start, r.stop) for r in df.collect()}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = suffixes.passages(docs).collect()
    assert {(r.doc_id, r.start, r.stop) for r in got} == want and len(want) > 100
    assert all(r.other != r.doc_id and r.words == r.stop - r.start for r in got)


def test_lengths_around_the_limit_and_nested_repeats(spark):
    rng = np.random.default_rng(4)

    def fresh(n):
        return [f"w{x}" for x in rng.integers(0, 10**9, n)]

    rows = []
    for n, size in enumerate((26, 40, 48, 49, 50, 51, 60, 75, 100, 300)):
        shared = fresh(size)
        rows += [(100 * n + k, " ".join(fresh(int(rng.integers(0, 60))) + shared + fresh(int(rng.integers(0, 60)))))
                 for k in range(2 + n % 3)]
    core, left, right = fresh(30), fresh(30), fresh(30)
    for k in range(90):
        rows.append((5000 + k, " ".join(fresh(20) + (left if k % 3 else fresh(30)) + core + (right if k % 4 == 0 else fresh(30)))))
    few, far = fresh(20), fresh(20)
    rows += [(6000 + k, " ".join((few if k in (7, 66) else fresh(20)) + core + (far if k in (3, 50) else fresh(20)))) for k in range(80)]
    rows.append((9000, " ".join(fresh(10) * 40)))
    rows.append((9001, " ".join(["same"] * 200)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert answer(suffixes.passages(docs)) == brute(rows)


def test_nulls_repeats_and_clashing_names(spark):
    long = " ".join(f"x{n}" for n in range(80))
    rows = [(1, long), (1, long), (2, "lead " + long.replace(" ", "\n")), (3, None), (4, ""), (None, long), (5, "short text")]
    docs = messy(spark, rows, "head")
    assert answer(suffixes.passages(docs)) == brute(rows) == {(1, 0, 80), (2, 1, 81)}
    assert suffixes.passages(docs.where("doc_id = 1")).collect() == []
    assert suffixes.passages(docs.limit(0)).collect() == []
