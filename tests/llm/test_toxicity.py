import numpy as np

from brute import messy
from logspark.llm import toxicity
from logspark.llm.common import held_out, ngrams
from logspark.llm.queries import QUERIES


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, toxic int, text string")


def test_ngrams_are_those_of_each_word():
    rows, found = ngrams(["abc", "x", "abc!", "Ünß"], 3, 6, 1 << 20)
    one = [sorted(found[rows == n]) for n in range(4)]
    assert one[0] == one[2] and len(one[0]) == 3 + 2 + 1 and len(one[1]) == 1 and len(one[3]) == 6
    alone = ngrams(["x"], 3, 6, 1 << 20)[1]
    assert sorted(alone) == one[1]


def test_unseen_misspellings(spark):
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "sol") for b in ("lan", "dor", "ven", "pik", "mus")]

    def text(toxic, size=40, word="grumblefoot"):
        return " ".join([*rng.choice(plain, size), *[word] * toxic])

    sizes = rng.integers(20, 800, 400)
    model = toxicity.train([text(n % 2 * (1 + size // 50), size) for n, size in enumerate(sizes)], np.arange(400) % 2)
    clean, long_clean, same, near, long = model.scores(
        [text(0), text(0, 800), text(2), text(2, 40, "grumblefeet"), text(16, 800)])
    assert max(clean, long_clean) < 0.5 < min(same, near, long)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, folder).collect()}
    marks = spark.read.parquet(f"{folder}/labels.parquet").where(held_out(toxicity.F.col("doc_id"))).collect()
    assert all(got[r.doc_id].held_out and 0 <= got[r.doc_id].score <= 1 for r in marks)
    right = [got[r.doc_id].predicted == r.toxic for r in marks]
    kept = [got[r.doc_id].predicted == 0 for r in marks if r.toxic == 0]
    found = [got[r.doc_id].predicted == 1 for r in marks if r.toxic == 1]
    assert np.mean(right) > 0.92 and np.mean(kept) > 0.95 and np.mean(found) > 0.7


def test_nulls_repeats_and_clashing_names(spark):
    docs = messy(spark, [(1, "a bad word"), (1, "a bad word"), (2, None), (3, ""), (None, "x"), (4, "good day")], "toxic")
    empty = labels(spark, [])
    for given, share in ((empty, 0), (labels(spark, [(1, 0, "x")]), 0), (labels(spark, [(1, 1, None), (None, 0, "")]), 1)):
        model = toxicity.fit(docs, given)
        scores = [r.score for r in toxicity.scored(docs, model).collect()]
        assert len(scores) == 6 and all(round(x) == share for x in scores)
    both = labels(spark, [(1, 0, ""), (1, 1, ""), (4, 0, ""), (2, None, ""), (3, 5, "")])
    model = toxicity.fit(docs, both)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {4} and 1 not in {r.doc_id for r in kept.collect()}
    assert toxicity.scored(docs.limit(0), model).collect() == []
