"""The corpus pipeline: toxic documents go, near-duplicates go, leaked test items go, secrets are masked, the rest is
packed into training sequences. Each stage is written as Parquet before the next one reads it.

Every stage but the last gives the columns of ``documents``. Rows without doc_id pass the stages that decide by
doc_id; null and empty texts are kept (they are neither toxic nor leaks), one of them per group of near-duplicates;
an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logspark.llm import decontaminate, minhash, packing, secrets, toxicity
from logspark.llm.common import read
from logspark.llm.queries import byte_tokenizer
from logspark.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, scores below 0.5."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group with 0.8 or more of their 5-word shingles in common.

    Candidates come from op9's SimHash fingerprints (``simhash.links``) and, for what differs in more bits, from MinHash keys.
    """
    return minhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their ids."""
    return packing.pack(docs, *byte_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: A trained classifier, fingerprints and a tokenizer: not for SQL. tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
