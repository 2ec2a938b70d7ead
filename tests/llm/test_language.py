import numpy as np

from brute import messy
from logspark.llm import language
from logspark.llm.common import held_out
from logspark.llm.queries import QUERIES

ROWS = [("the cat and the dog are here with this thing", "en"), ("der hund und die katze sind nicht hier", "de")] * 5


def test_mixture_matches_plain_expectation_maximisation():
    rng = np.random.default_rng(2)
    counts = np.array([3, 40, 7])
    given = rng.random((50, 3)).astype(np.float32)
    allowed = np.array([[1, 1, 1], [1, 0, 1], [0, 1, 0]], bool)
    shares, value = language.fit_mixture(given, counts, allowed, 9)
    for n, (at, size) in enumerate(zip((0, 3, 43), counts)):
        own, p = given[at:at + size].astype(float), allowed[n] / allowed[n].sum()
        for _ in range(9):
            joint = own * p
            p = (joint / joint.sum(1, keepdims=True)).mean(0)
        assert np.allclose(shares[n], p, atol=1e-4) and abs(value[n] - np.log((own * p).sum(1)).sum()) < 1e-2


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op7_language"](spark, folder).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").where(
        held_out(language.F.col("doc_id"))).collect()}
    assert len(rows) == 10_000 and {r.doc_id for r in rows if r.held_out} == set(truth)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.98
    assert all(0 <= r.score <= 1 and abs(sum(r.shares) - 1) < 1e-3 for r in rows if r.lang_pred != "und")


def test_two_languages_in_one_text(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(docs)
    own = {lang: [r.text for r in docs.where(f"lang = '{lang}' and length(text) > 1500").limit(3).collect()]
           for lang in ("en", "de")}
    mixed = model.predict([own["en"][0][:1000] + " " + own["de"][0][:1000], own["en"][1], own["de"][1]])
    assert set(mixed[0]) == {"en", "de"} and min(mixed[0].values()) > 0.3
    assert [set(m) for m in mixed[1:]] == [{"en"}, {"de"}]


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, "123 -- !"), (4, "the thing"), (4, "the thing"), (None, "und die katze"), (5, "中文")]
    docs = messy(spark, rows, "lang")
    model = language.train(ROWS)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.identified(docs, model).collect())
    assert got[:6] == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")] and got[6][1] in ("de", "en")
    assert {r.score for r in language.identified(docs, model).where("lang_pred = 'und'").collect()} == {0.0}
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identified(docs, nothing).collect()} == {"und"}
    assert language.identified(docs.limit(0), model).collect() == []
