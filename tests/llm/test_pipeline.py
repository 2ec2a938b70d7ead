import struct

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logspark.llm import toxicity
from logspark.llm.queries import byte_tokenizer
from test_decontaminate import brute as leaks
from test_minhash import brute as similar
from test_secrets import base_spans

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], FOLDER).cache())
    return found


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_every_stage_but_the_last_keeps_the_columns(outputs):
    for df in outputs[1:-1]:
        assert df.dtypes == outputs[0].dtypes
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_toxic_documents_go(spark, outputs):
    docs = outputs[0].collect()
    model = toxicity.fit(outputs[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = dict(zip((r.doc_id for r in docs), model.scores([r.text for r in docs])))
    assert ids(outputs[1]) == {i for i, s in scores.items() if s < 0.5}


def test_one_document_of_each_group_stays(outputs):
    want = similar([(r.doc_id, r.text) for r in outputs[1].collect()])
    assert ids(outputs[2]) == want and len(want) < outputs[1].count()


def test_leaks_go(spark, outputs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = {i for i, *_ in leaks([(r.doc_id, r.text) for r in outputs[2].collect()], items)}
    assert ids(outputs[3]) == ids(outputs[2]) - found and found


def test_secrets_are_masked_and_nothing_else(outputs):
    before = {r.doc_id: r.text for r in outputs[3].collect()}
    changed = 0
    for r in outputs[4].collect():
        spans = base_spans(before[r.doc_id])
        assert r.n_chars == len(r.text)
        if not spans:
            assert r.text == before[r.doc_id]
            continue
        changed += 1
        assert not base_spans(r.text)
        assert r.text.startswith(before[r.doc_id][:spans[0][0]]) and r.text.count("[SECRET]") >= 1
    assert ids(outputs[4]) == set(before) and changed


def test_packing_holds_every_id(outputs):
    plain = Tokenizer.from_file(byte_tokenizer()[0])
    held = {}
    for p in outputs[5].orderBy("doc_id", "start").collect():
        held[p.doc_id] = held.get(p.doc_id, b"") + bytes(p.ids)
    for r in outputs[4].collect():
        own = [*plain.encode(r.text, add_special_tokens=False).ids, 0]
        assert held[r.doc_id] == struct.pack(f"<{len(own)}I", *own)


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, ""), (None, None)],
        "doc_id bigint, text string").select("doc_id", "text", F.lit("x").alias("lang"), F.lit("y").alias("source"),
                                             F.length("text").cast("bigint").alias("n_chars"))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 3]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
        assert stage(spark, docs, FOLDER).count() > 0, name


def test_run_gives_the_last_stage(spark, outputs):
    """The same tokens of the same documents; where pieces are cut depends on how the rows are dealt."""
    def tokens(df):
        return {r.doc_id: (r.n, r.all) for r in df.groupBy("doc_id").agg(
            F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()}

    found = tokens(corpus_pipeline.run(spark, FOLDER))
    assert found == tokens(outputs[5]) and all(n == every for n, every in found.values())
