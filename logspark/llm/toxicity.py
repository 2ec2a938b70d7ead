"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 6, with marks at both ends); its vector is the mean of their
vectors, a text's vector the sum of its words' by the square root of their number (by their number itself, a few toxic words
would drown in a long text), and a linear softmax over that gives the two classes. Vectors
and softmax are trained together in numpy, by Adam over all rows of the sample at once. A misspelt word shares
most n-grams with the right one and so most of its vector.

Since everything after the vectors is linear, a text's logit is that average of its words' logits. Scoring keeps
the logits of words in a bounded memory per Python worker and needs no shuffle. Only the text is looked at.

Learning uses a bounded sample of labelled rows (``Settings.per_class`` rows of each class, none longer than
``max_chars``), drawn by a hash of doc_id among rows that are not held out. Every row is scored, over its whole text.

Cases: null or empty text gets the score of the bias alone; without labels of both classes the score is
the share of toxic labels seen, 0 without any; a doc_id labelled both ways counts as toxic; repeated rows are scored alike;
rows without doc_id are scored and held out; empty tables give none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm.common import held_out, ngrams, texts

@dataclass(frozen=True)
class Settings:
    per_class: int = 3_000
    max_chars: int = 8_000
    shortest: int = 3
    longest: int = 6
    buckets: int = 1 << 20
    dimensions: int = 4
    epochs: int = 60
    rate: float = 0.1
    decay: float = 3e-5
    #: Words whose logits one Python worker keeps; when full, the memory starts anew.
    memory_words: int = 600_000

    @property
    def bag(self) -> tuple[int, int, int]:
        return self.shortest, self.longest, self.buckets


DEFAULT = Settings()


class Model:
    """Logit difference per bucket, and the bias."""

    def __init__(self, logits: np.ndarray, bias: float, settings: Settings = DEFAULT) -> None:
        self.logits, self.bias, self.settings = logits, bias, settings
        self.memory: dict[str, float] = {}

    def word_logits(self, words: list[str]) -> np.ndarray:
        row, bucket = ngrams(words, *self.settings.bag)
        count = np.bincount(row, minlength=len(words))
        return np.bincount(row, self.logits[bucket], len(words)) / np.maximum(count, 1)

    def scores(self, batch: list[str]) -> list[float]:
        memory = self.memory
        out = []
        for text in batch:
            words = text.lower().split()
            new = [word for word in set(words) if word not in memory]
            if new:
                if len(memory) + len(new) > self.settings.memory_words:
                    memory.clear()
                    new = list(set(words))
                memory.update(zip(new, self.word_logits(new).tolist()))
            mean = sum([memory[word] for word in words]) / len(words) ** 0.5 if words else 0.0
            out.append(1 / (1 + np.exp(-np.clip(mean + self.bias, -700, 700))))
        return out


def train(batch: list[str], labels: np.ndarray, settings: Settings = DEFAULT) -> Model:
    """Fit the n-gram vectors and the softmax together."""
    labels = np.asarray(labels, float)
    if len(set(labels)) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(settings.buckets, np.float32), np.inf if share == 1 else -np.inf if share == 0 else 0.0, settings)
    number: dict[str, int] = {}
    docs, words = [], []
    for n, text in enumerate(batch):
        own = [number.setdefault(word, len(number)) for word in text.lower().split()]
        words.append(np.array(own, np.int32))
        docs.append(np.full(len(own), n, np.int32))
    words, docs = np.concatenate(words), np.concatenate(docs)
    owner, bucket = ngrams(list(number), *settings.bag)
    owner = owner.astype(np.int32)
    used, column = np.unique(bucket, return_inverse=True)
    column = column.astype(np.int32)
    per_word = 1 / np.maximum(np.bincount(owner, minlength=len(number)), 1)
    per_doc = np.maximum(np.bincount(docs, minlength=len(batch)), 1) ** -0.5

    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.1, (len(used), settings.dimensions))
    softmax = rng.normal(0, 1, (settings.dimensions, 2))
    bias = np.log([1 - labels.mean(), labels.mean()])
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    parameters = [vectors, softmax, bias]
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for step in range(1, settings.epochs + 1):
        # The text's vector only enters through its products with the two softmax columns.
        direction = softmax[:, 1] - softmax[:, 0]
        of_words = np.bincount(owner, (vectors @ direction)[column], len(number)) * per_word
        logit = np.bincount(docs, of_words[words], len(batch)) * per_doc + bias[1] - bias[0]
        wrong = weight * (1 / (1 + np.exp(-logit)) - labels) / len(batch)
        back = np.bincount(words, (wrong * per_doc)[docs], len(number)) * per_word
        gain = np.bincount(column, back[owner], len(used))
        pull = vectors.T @ gain
        slopes = [np.outer(gain, direction) + settings.decay * vectors,
                  np.stack([-pull, pull], 1), np.array([-wrong.sum(), wrong.sum()])]
        for p, slope, m, v in zip(parameters, slopes, first, second):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            p -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    logits = np.zeros(settings.buckets, np.float32)
    logits[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(logits, float(bias[1] - bias[0]), settings)


def sample(docs: DataFrame, labels: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(text, toxic) of at most ``per_class`` documents of each class that aren't held out."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(
        ~held_out(F.col("doc_id")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    counts = {row["toxic"]: row["n"] for row in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for toxic, count in sorted(counts.items()):
        # Three times what is wanted passes the first sieve, so no task gets more than a few rows to order.
        likely = marked.where((F.col("toxic") == toxic) & (draw < int(min(1, 3 * settings.per_class / count) * (1 << 31))))
        part = likely.orderBy(draw, "doc_id").limit(settings.per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    given = texts(docs).where(F.length("text") <= settings.max_chars)
    if chosen is None:
        return given.limit(0).select("text", F.lit(0).alias("toxic"))
    # Two rows for each of per_class ids at most.
    return given.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = DEFAULT) -> Model:
    rows = sample(docs, labels, settings).collect()
    return train([row["text"] for row in rows], np.array([row["toxic"] for row in rows]), settings)


def _shared(spark, model: Model):
    """A function that gives each Python worker the model, with the worker's own memory of words."""
    sent = spark.sparkContext.broadcast((model.logits, model.bias, model.settings))
    return lambda: Model(*sent.value)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    load = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own.scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, less the rows that score ``threshold`` or more. Rows are judged where they lie."""
    load = _shared(docs.sparkSession, model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load()
        for batch in batches:
            given = [text or "" for text in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(np.array(own.scores(given)) < threshold))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
