"""Language identification as a mixture: which languages a document is written in, and in what proportions.

Each language has the probabilities of its words' character n-grams (2 and 3, smoothed). A word's likelihood under a
language is the product over its n-grams. A document's words are drawn from a mixture of languages;
expectation-maximisation estimates the proportions. The set of languages is chosen by penalised
likelihood: languages are taken in by their proportion in the full mixture, one by one, as long as the log-likelihood of the
refitted mixture rises by more than ``penalty`` times the log of the number of words. The prediction is the largest proportion.

Learning uses a bounded sample: about ``per_language`` documents of each language, none longer than
``max_chars``, drawn by a hash of doc_id among rows that aren't held out. Every row is predicted, over its whole text;
no shuffle.

Cases: null text and text without a letter are ``und`` with score 0, as is everything when nothing was learned; ties go to
the language first by name; repeated rows are predicted alike; rows without doc_id are predicted and held
out; empty tables give none; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import held_out, ngrams, texts

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    per_language: int = 500
    #: Fewer per language where there are so many languages that the sample would pass this.
    most_rows: int = 20_000
    max_chars: int = 4_000
    buckets: int = 1 << 16
    smoothing: float = 0.05
    rounds: int = 12
    penalty: float = 3.0
    #: Words whose likelihoods one Python worker keeps; when full, the memory starts anew.
    memory_words: int = 500_000
    #: Words of texts that go through expectation-maximisation together.
    words_at_once: int = 200_000


DEFAULT = Settings()


def _words(text: str) -> list[str]:
    return text.lower().split()


class Model:
    """``table``: log-probability of each n-gram bucket under each language."""

    def __init__(self, languages: list[str], table: np.ndarray, settings: Settings = DEFAULT) -> None:
        self.languages, self.table, self.settings = languages, table, settings
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.likelihoods = np.zeros((1 << 12, len(self.languages)), np.float32)

    def _numbers(self, words: list[str]) -> list[int]:
        """Rows of ``likelihoods``, -1 for words without a letter."""
        number = self.number
        new = [word for word in set(words) if word not in number]
        if new:
            if len(number) + len(new) > self.settings.memory_words:
                self._forget()
                number = self.number
                new = list(set(words))
            lettered = [word for word in new if any(map(str.isalpha, word))]
            number.update(dict.fromkeys(new, -1))
            if lettered:
                start = self.used
                needed = start + len(lettered)
                while len(self.likelihoods) < needed:
                    self.likelihoods = np.concatenate([self.likelihoods, np.zeros_like(self.likelihoods)])
                row, bucket = ngrams(lettered, 2, 3, self.settings.buckets)
                for n in range(len(self.languages)):
                    # Every letter is in a 2-gram and a 3-gram: half of each.
                    self.likelihoods[start:needed, n] = np.bincount(row, self.table[n, bucket], len(lettered)) / 2
                number.update(zip(lettered, range(start, needed)))
                self.used = needed
        return [number[word] for word in words]

    @property
    def used(self) -> int:
        return getattr(self, "_used", 0) if self.number else 0

    @used.setter
    def used(self, value: int) -> None:
        self._used = value

    def predict(self, batch: list[str | None]) -> list[dict[str, float]]:
        """Proportions of the chosen languages of each text, largest first; none where nothing can be said."""
        out: list[dict[str, float]] = [{} for _ in batch]
        if not self.languages:
            return out
        waiting, sizes, size = [], [], 0
        for n, text in enumerate(batch):
            own = np.array(self._numbers(_words(text or "")), np.int64)
            own = own[own >= 0]
            if len(own):
                waiting.append(self.likelihoods[own])
                sizes.append((n, len(own)))
                size += len(own)
            if size >= self.settings.words_at_once:
                self._mix(waiting, sizes, out)
                waiting, sizes, size = [], [], 0
        if waiting:
            self._mix(waiting, sizes, out)
        return out

    def _mix(self, waiting: list[np.ndarray], sizes: list[tuple[int, int]], out: list[dict[str, float]]) -> None:
        logs = np.concatenate(waiting)
        rows, counts = (np.array(x) for x in zip(*sizes))
        tops = logs.max(1)
        starts = np.cumsum(counts) - counts
        alone = np.add.reduceat(logs, starts, dtype=np.float64)
        bound = np.add.reduceat(tops, starts, dtype=np.float64)
        price = self.settings.penalty * np.log(counts + 1)
        chosen = np.zeros(alone.shape)
        chosen[np.arange(len(rows)), alone.argmax(1)] = 1
        best = alone.max(1)
        # No mixture is likelier than each word under its own best language.
        open_ = np.flatnonzero(bound - best > price)
        if len(open_) and len(self.languages) > 1:
            kept = np.isin(np.repeat(np.arange(len(rows)), counts), open_)
            given, many = np.exp(logs[kept] - tops[kept, None]), counts[open_]
            everything, _ = fit_mixture(given, many, np.ones((len(open_), len(self.languages)), bool), self.settings.rounds)
            order = np.argsort(-everything, 1, kind="stable")
            allowed = np.zeros(everything.shape, bool)
            active = np.arange(len(open_))
            allowed[active, alone[open_].argmax(1)] = True
            score = best[open_] - bound[open_]
            for step in range(len(self.languages)):
                # The next language by proportion that isn't in the set yet.
                wanted = order[active, step]
                fresh = ~allowed[active, wanted]
                trial = allowed[active].copy()
                trial[np.arange(len(active)), wanted] = True
                trial_rows = active[fresh]
                if not len(trial_rows):
                    continue
                words = np.isin(np.repeat(np.arange(len(open_)), many), trial_rows)
                shares, value = fit_mixture(given[words], many[trial_rows], trial[fresh], self.settings.rounds)
                better = value - score[trial_rows] > price[open_][trial_rows]
                won = trial_rows[better]
                allowed[won] = trial[fresh][better]
                score[won] = value[better]
                chosen[open_[won]] = shares[better]
                lost = set(trial_rows[~better].tolist())
                active = np.array([a for a in active.tolist() if a not in lost], int)
                if not len(active):
                    break
        for row, shares in zip(rows, chosen):
            out[row] = {self.languages[n]: float(shares[n]) for n in np.argsort(-shares, kind="stable") if shares[n] > 0}


def fit_mixture(
    given: np.ndarray, counts: np.ndarray, allowed: np.ndarray, rounds: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of many texts at once.

    ``given``: likelihood of each word under each language, ``counts`` words a text, ``allowed`` languages a text.
    """
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    shares = allowed / allowed.sum(1, keepdims=True)
    value, ones = np.zeros(len(counts)), np.ones(given.shape[1], np.float32)
    for step in range(rounds + 1):
        joint = given * shares.astype(np.float32)[owner]
        total = joint @ ones + np.float32(1e-30)
        value = np.add.reduceat(np.log(total), starts, dtype=np.float64)
        if step < rounds:
            shares = np.add.reduceat(joint / total[:, None], starts, dtype=np.float64) / counts[:, None]
    return shares, value


def train(rows: list[tuple[str, str]], settings: Settings = DEFAULT) -> Model:
    """From (text, language) rows."""
    languages = sorted({language for _, language in rows})
    table = np.zeros((len(languages), settings.buckets), np.float32)
    for n, language in enumerate(languages):
        counted: Counter[str] = Counter()
        for text, own in rows:
            if own == language:
                counted.update(word for word in _words(text) if any(map(str.isalpha, word)))
        row, bucket = ngrams(list(counted), 2, 3, settings.buckets)
        weights = np.array(list(counted.values()), float)
        found = np.bincount(bucket, weights[row] if len(row) else None, settings.buckets) + settings.smoothing
        table[n] = np.log(found / found.sum())
    return Model(languages, table, settings)


def sample(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(text, lang): about ``per_language`` rows of each language."""
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                        F.col("text").cast("string").alias("text"))
    usable = given.where("doc_id is not null and lang is not null and text is not null").where(
        (F.length("text") <= settings.max_chars) & ~held_out(F.col("doc_id")))
    counts = {row["lang"]: row["n"] for row in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return usable.limit(0).select("text", "lang")
    wanted = min(settings.per_language, settings.most_rows // len(counts))
    bounds = F.create_map(*[x for lang, n in counts.items() for x in (
        F.lit(lang), F.lit(int(min(1, wanted / n) * (1 << 31))))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.element_at(bounds, F.col("lang"))
    return usable.where(drawn).dropDuplicates(["doc_id"]).orderBy("doc_id").select("text", "lang")


def fit(docs: DataFrame, settings: Settings = DEFAULT) -> Model:
    return train([(row["text"], row["lang"]) for row in sample(docs, settings).collect()], settings)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            found = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([next(iter(f), UNKNOWN) for f in found], pa.string()),
                pa.array([min(1.0, next(iter(f.values()), 0.0)) for f in found], pa.float64()),
                pa.array([list(f) for f in found], pa.list_(pa.string())),
                pa.array([list(f.values()) for f in found], pa.list_(pa.float64())),
            ], ["doc_id", "lang_pred", "score", "languages", "shares"])

    return texts(docs).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, languages array<string>, shares array<double>")
