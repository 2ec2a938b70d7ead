"""Classifier on the tail of a trace: which events, and which pairs at distance 1, 2 and 4.

A logistic regression on sparse term counts. Terms are numbered by a distributed rank and joined; the vocabulary never comes to
the driver, only one coefficient per term and setting does, and no more than ``MAX_TERMS`` of them. All settings are
fitted in the same passes: a pass gives loss and gradient of every setting that has not converged, summed per task and then by Spark,
and the driver takes an L-BFGS step for each. Equal traces are one row with a weight.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.functions import columns as C
from logspark.operators import metrics, split
from logspark.operators.encode import join_codes
from logspark.operators.sequences import padded_tokens
from logspark.session import sized, stage, written

DISTANCES = (1, 2, 4)
#: Coefficients of a setting: 8 MB. With more different terms ``min_count`` has to be raised.
MAX_TERMS = 1 << 20
#: Steps of a fit, and the relative change of the loss at which it ends.
MAX_STEPS = 50
TOLERANCE = 1e-6
#: Different traces of a task in a pass.
ROWS_PER_TASK = 50_000
#: Steps that a fit looks back on.
MEMORY = 10


def trace_terms(tokens: Column) -> Column:
    """Terms of a padded token array; padding gives none."""
    single = F.transform(F.filter(tokens, lambda t: t > 0), lambda t: F.concat(F.lit("e"), t.cast("string")))
    groups = [single, F.array(F.concat(F.lit("last"), F.element_at(tokens, -1).cast("string")))]
    for distance in DISTANCES:
        reach = F.size(tokens) - distance
        pairs = F.arrays_zip(
            F.slice(tokens, F.lit(1), F.greatest(reach, F.lit(0))).alias("a"),
            F.slice(tokens, F.lit(1 + distance), F.greatest(reach, F.lit(0))).alias("b"))
        groups.append(F.transform(
            F.filter(pairs, lambda p: p.a > 0),
            lambda p: F.concat_ws("_", F.lit(f"d{distance}"), p.a.cast("string"), p.b.cast("string"))))
    return F.concat(*groups)


def shapes_of(traces: DataFrame, label: str) -> DataFrame:
    """(id, tokens, label, weight): different traces, written."""
    weighted = traces.groupBy("tokens", label).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return written(weighted.withColumn("id", F.monotonically_increasing_id()), "shapes")


def term_index(shapes: DataFrame, min_count: int = 1) -> DataFrame:
    """(term, code): the terms that stand ``min_count`` times or more, numbered from 0 in text order.

    They are counted before they are numbered, so the one task that does this has ``MAX_TERMS`` rows at most.
    """
    counts = written(shapes.select(F.explode(trace_terms(F.col("tokens"))).alias("term"), "weight").groupBy("term").agg(
        F.sum("weight").alias("n")).where(F.col("n") >= min_count).select("term"), "terms")
    found = counts.count()
    if found > MAX_TERMS:
        raise ValueError(f"{found} different terms: raise min_count to have at most {MAX_TERMS}")
    return stage(counts.withColumn("code", F.row_number().over(W.orderBy("term")).cast("bigint") - 1))


def vectorise(shapes: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, codes, counts) of ``shapes`` (id, tokens): sparse vectors, codes rising; terms without code give none."""
    each = shapes.select("id", F.explode(trace_terms(F.col("tokens"))).alias("term")).groupBy("id", "term").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("code", "n")))
    # As many entries as a tail has terms.
    return each.join(sized(terms), "term").groupBy("id").agg(entries.alias("_e")).select(
        "id", F.col("_e.code").alias("codes"), F.col("_e.n").alias("counts"))


def _lbfgs(start: np.ndarray) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Asks for loss and gradient of points, and gives the last one taken."""
    point, past = start, []
    loss, slope = yield point
    for _ in range(MAX_STEPS):
        way, kept = -slope, []
        for s, y, r in reversed(past):
            kept.append(r * (s @ way))
            way = way - kept[-1] * y
        if past:
            s, y, r = past[-1]
            way = way / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(kept)):
            way = way + (a - r * (y @ way)) * s
        descent = slope @ way
        if descent >= 0:
            way, descent, past = -slope, -(slope @ slope), []
        step = 1.0 if past else min(1.0, 1.0 / max(np.abs(slope).sum(), 1e-300))
        for _ in range(20):
            following = point + step * way
            new_loss, new_slope = yield following
            if new_loss <= loss + 1e-4 * step * descent:
                break
            step /= 2
        else:
            return point
        s, y = following - point, new_slope - slope
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y, 1.0 / (s @ y))][-MEMORY:]
        settled = loss - new_loss <= TOLERANCE * max(abs(loss), abs(new_loss), 1e-9)
        point, loss, slope = following, new_loss, new_slope
        if settled:
            break
    return point


def _losses(rows: DataFrame, label: str, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed loss (setting) and gradient (setting, term; the constant last) at ``points``, one pass over ``rows``."""
    sent = rows.sparkSession.sparkContext.broadcast(points)
    settings, width = points.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, np.zeros((settings, width + 1))
        for batch in batches:
            n = batch.num_rows
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), sizes)
            code, count = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
            sign = 2.0 * batch.column(2).to_numpy(zero_copy_only=False).astype(float) - 1.0
            weight = batch.column(3).to_numpy(zero_copy_only=False)
            for s in range(settings):
                margin = sign * (np.bincount(row, count * own[s, code], minlength=n) + own[s, -1])
                total[s, -1] += weight @ np.logaddexp(0.0, -margin)
                pull = -weight * sign / (1.0 + np.exp(np.clip(margin, -500, 500)))
                total[s, :width - 1] += np.bincount(code, count * pull[row], minlength=width - 1)
                total[s, width - 1] += pull.sum()
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], ["place", "value"])

    total = np.zeros(settings * (width + 1))
    sums = rows.select("codes", "counts", label, "weight").mapInArrow(part, "place bigint, value double").groupBy("place").agg(
        F.sum("value").alias("value"))
    for row in sums.collect():
        total[row["place"]] = row["value"]
    total = total.reshape(settings, width + 1)
    return total[:, -1], total[:, :-1]


def fit_settings(features: DataFrame, label: str, width: int, regs: tuple[float, ...]) -> np.ndarray:
    """Coefficients (setting, term; the constant last) from (codes, counts, label, weight).

    Mean logistic loss plus ``reg`` / 2 times the squared coefficients of terms scaled to a deviation of 1.
    """
    entries = features.select("weight", F.explode(F.arrays_zip("codes", "counts")).alias("e")).groupBy("e.codes").agg(
        F.sum(F.col("weight") * F.col("e.counts")).alias("one"), F.sum(F.col("weight") * F.col("e.counts") ** 2).alias("two"))
    n, positive = features.agg(F.sum("weight"), F.sum(F.col("weight") * F.col(label))).first()
    scale = np.zeros(width + 1)
    for row in entries.collect():  # one row per term
        scale[row["codes"]] = np.sqrt(max(row["two"] / n - (row["one"] / n) ** 2, 0.0))
    scale = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 1e-9)
    scale[-1] = 1.0
    start = np.zeros(width + 1)
    start[-1] = np.log((positive + 0.5) / (n - positive + 0.5))
    fits = {s: _lbfgs(start) for s in range(len(regs))}
    asked = {s: next(fit) for s, fit in fits.items()}
    found = np.zeros((len(regs), width + 1))
    while asked:
        order = sorted(asked)
        losses, slopes = _losses(features, label, np.array([asked[s] * scale for s in order]))
        for s, loss, slope in zip(order, losses, slopes):
            bent = regs[s] * np.r_[asked[s][:-1], 0.0]
            try:
                asked[s] = fits[s].send((loss / n + bent @ asked[s] / 2, slope * scale / n + bent))
            except StopIteration as done:
                found[s] = done.value * scale
                del asked[s]
    return found


@dataclass
class SequenceClassifier:
    """A model with all that scoring needs: the weight of each term, as a table (term, weight), the constant, the
    threshold, the length of its input and, for raw events, the codes."""

    weights: DataFrame
    constant: float
    threshold: float = 0.5
    length: int | None = None
    codes: DataFrame | None = None

    def transform(self, traces: DataFrame) -> DataFrame:
        """Add ``prob`` and ``pred`` to rows with ``tokens``; each different trace is scored once."""
        shapes = traces.select("tokens").distinct()
        each = shapes.select("tokens", F.explode(trace_terms(F.col("tokens"))).alias("term"))
        margin = each.join(sized(self.weights), "term", "left").groupBy("tokens").agg(
            C.sigmoid(F.coalesce(F.sum("weight"), F.lit(0.0)) + F.lit(self.constant)).alias("prob"))
        known = sized(margin.withColumnRenamed("tokens", "_tokens"))
        return traces.join(known, F.col("tokens") == F.col("_tokens"), "left").drop("_tokens").withColumn(
            "pred", C.above(F.col("prob"), self.threshold))

    def score_events(self, events: DataFrame, key: str, order: list[str], event: str = "event_id") -> DataFrame:
        """``key, tokens, prob, pred`` from raw events: the codes of training, 0 for events it did not see."""
        if self.codes is None or self.length is None:
            raise ValueError("this model was saved without codes or length")
        coded = join_codes(events, self.codes, event).withColumn("_token", F.col("code") + 1)
        return self.transform(padded_tokens(coded, key, order, "_token", self.length))

    def save(self, path: str) -> None:
        """Replace what is at ``path``."""
        spark = SparkSession.active()
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        tokens = None if self.codes is None else self.codes.count() + 2
        spark.createDataFrame([(self.constant, self.threshold, self.length, tokens)], _SETTINGS).write.mode("overwrite").parquet(
            f"{path}/settings")
        if self.codes is not None:
            self.codes.select("event_id", "code").write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, path: str) -> SequenceClassifier:
        spark = SparkSession.active()
        kept = spark.read.schema(_SETTINGS).parquet(f"{path}/settings").first()
        codes = spark.read.parquet(f"{path}/codes") if kept["num_tokens"] is not None else None
        return cls(spark.read.schema(_WEIGHTS).parquet(f"{path}/weights"), kept["constant"], kept["threshold"], kept["length"], codes)


_SETTINGS = "constant double, threshold double, length int, num_tokens bigint"
_WEIGHTS = "term string, weight double"


def _named(terms: DataFrame, coefficients: np.ndarray) -> DataFrame:
    """(term, weights), a weight per setting. The coefficients are sent around; names stay where they are."""
    sent = terms.sparkSession.sparkContext.broadcast(np.ascontiguousarray(coefficients.T))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(sent.value[np.asarray(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.float64()))], ["term", "weights"])

    return written(terms.select("term", "code").mapInArrow(name, "term string, weights array<double>"), "weights")


def fit_all(
    traces: DataFrame, label: str = "y", regs: tuple[float, ...] = (0.01,), threshold: float = 0.5, length: int | None = None,
    codes: DataFrame | None = None, min_count: int = 1,
) -> list[SequenceClassifier]:
    """A classifier per setting, from rows with ``tokens`` and a 0 / 1 label."""
    shapes = shapes_of(traces, label)
    terms = term_index(shapes, min_count)
    width = terms.count()
    tasks = max(1, -(-shapes.count() // ROWS_PER_TASK))
    vectors = vectorise(shapes.select("id", "tokens"), terms)
    features = written(shapes.select("id", label, "weight").join(vectors, "id", "left").select(
        label, "weight", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("codes", "array<bigint>"), ("counts", "array<double>"))]
    ).repartition(tasks), "features")
    if features.isEmpty():
        raise ValueError("no traces to learn from")
    found = fit_settings(features, label, width, regs)
    named = _named(terms, found[:, :-1])
    return [
        SequenceClassifier(named.select("term", F.col("weights")[n].alias("weight")), float(own[-1]), threshold, length, codes)
        for n, own in enumerate(found)]


def fit_sequence(
    traces: DataFrame, label: str = "y", reg: float = 0.01, threshold: float = 0.5, length: int | None = None,
    codes: DataFrame | None = None, min_count: int = 1,
) -> SequenceClassifier:
    """Fit one setting."""
    return fit_all(traces, label, (reg,), threshold, length, codes, min_count)[0]


def _judged(rows: DataFrame, models: list[SequenceClassifier]) -> DataFrame:
    """Metrics per model (``epoch``, from 1) and split of ``rows`` (tokens, y, split)."""
    every = models[0].weights.select("term", F.col("weight").alias("_w1"))
    for n, model in enumerate(models[1:], 2):
        every = every.join(model.weights.select("term", F.col("weight").alias(f"_w{n}")), "term")
    names = [f"_w{n}" for n in range(1, len(models) + 1)]
    shapes = rows.groupBy("tokens", "y", "split").agg(F.count(F.lit(1)).alias("_n"))
    margins = shapes.withColumn("term", F.explode(trace_terms(F.col("tokens")))).join(sized(every), "term", "left").groupBy(
        "tokens", "y", "split", "_n").agg(*[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in names])
    judged = F.inline(F.array(*[F.struct(
        F.lit(n).alias("epoch"), C.above(C.sigmoid(F.col(f"_w{n}") + F.lit(model.constant)), model.threshold).alias("pred"))
        for n, model in enumerate(models, 1)]))
    counts = margins.select("y", "split", "_n", judged).groupBy("epoch", "split").agg(*[
        F.coalesce(F.sum(F.when((F.col("pred") == p) & (F.col("y") == a), F.col("_n"))), F.lit(0)).alias(name)
        for name, (p, a) in {"tn": (0, 0), "fp": (1, 0), "fn": (0, 1), "tp": (1, 1)}.items()])
    return metrics.prf(counts)


def select_model(
    traces: DataFrame, key: str, path: str, regs: tuple[float, ...] = (0.1, 0.01, 0.001),
    val_frac: float = 0.1, test_frac: float = 0.1, seed: int | None = 42, threshold: float = 0.5,
    length: int | None = None, codes: DataFrame | None = None, min_count: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Fit one model per setting, all in the same passes, keep the best on validation data, test that one once.

    Train and validation rows are judged by all models in one pass over different traces. Gives the metrics (``epoch, split, tn, fp, fn, tp, accuracy, precision, recall, f1``) and the test scores (``key, prob,
    y``). There is a train and, where there are validation rows, a val row per setting, and a test row for the model
    kept, which is saved at ``path`` with its settings. Without validation rows the last model is kept.
    """
    rows = split.positional_split(traces.select(key, "tokens", "y"), key, val_frac, test_frac, seed)
    parts = {name: rows.where(F.col("split") == name).drop("split") for name in ("train", "val", "test")}
    models = fit_all(parts["train"], "y", regs, threshold, length, codes, min_count)
    found = {(row["epoch"], row["split"]): row for row in _judged(rows.where(F.col("split") != "test"), models).collect()}
    results, best_accuracy, best = [], -1.0, 0
    for epoch in range(1, len(models) + 1):
        own = [name for name in ("train", "val") if (epoch, name) in found]
        results += [(epoch, name, *[found[epoch, name][c] for c in _METRICS]) for name in own]
        # Strictly better only, so the earliest of equals stays; without validation each one replaces the last.
        accuracy = results[-1][6] if "val" in own else best_accuracy + 1
        if accuracy > best_accuracy:
            best_accuracy, best = accuracy, epoch
    models[best - 1].save(path)
    scores = SequenceClassifier.load(path).transform(parts["test"]).select(key, "prob", "y")
    if not parts["test"].isEmpty():
        row = metrics.prf_metrics(scores, threshold).first()
        results.append((best, "test", *[row[c] for c in _METRICS]))
    return traces.sparkSession.createDataFrame(
        results, "epoch int, split string, tn bigint, fp bigint, fn bigint, tp bigint, accuracy double, "
                 "precision double, recall double, f1 double"), scores


_METRICS = ("tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1")
