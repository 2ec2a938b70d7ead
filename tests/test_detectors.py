"""Detectors against numpy, and on planted anomalies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logspark.detectors import clustering, forest, invariants, next_event, pca, report, sequence, supervised, vectors
from logspark.operators import encode, metrics, sequences, split
from logspark.workload import views as V

COLUMNS = ["E1", "E2", "E3", "E4", "E5"]


def planted(seed=1, n=600, bad=30):
    """Normal sessions: E2 = 3 E1, E3 = E1, E4 rare. Planted ones break that."""
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 4, n)
    values = np.stack([base, 3 * base, base, rng.random(n) < 0.02, 2 * np.ones(n)], axis=1).astype(int)
    y = np.zeros(n, int)
    y[:bad] = 1
    values[:bad, 2] += rng.integers(6, 10, bad)
    values[:bad, 3] += rng.integers(5, 9, bad)
    return values, y


@pytest.fixture(scope="module")
def matrix(spark):
    values, y = planted()
    frame = pd.DataFrame(values, columns=COLUMNS).assign(block_id=[f"b{n:04d}" for n in range(len(y))], label=y)
    frame["split"] = np.where(np.arange(len(y)) % 2 == 0, "train", "test")
    return spark.createDataFrame(frame).persist()


def quality(flags):
    row = metrics.prf(metrics.confusion_of(flags.select("pred", F.col("label").alias("y")))).first()
    return row.precision, row.recall


def test_sums(matrix):
    values, _ = planted()
    rows = vectors.distinct_vectors(matrix, COLUMNS)
    assert rows.count() == len(np.unique(values, axis=0))
    full = np.hstack([np.ones((len(values), 1)), values])
    assert np.array_equal(vectors.gram(rows, COLUMNS), full.T @ full)
    assert np.allclose(vectors.idf_weights(rows, COLUMNS), np.log(len(values) / (values > 0).sum(axis=0)))


def test_pca_scores(matrix):
    values, _ = planted()
    model = pca.fit_pca(matrix, COLUMNS, components=2, weighting="none")
    centred = values - values.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    rest = centred - centred @ vt[:2].T @ vt[:2]
    got = [r.score for r in model.transform(matrix).orderBy("block_id").collect()]
    assert np.allclose(got, (rest**2).sum(axis=1), atol=1e-9)
    assert model.threshold == pytest.approx(pca.q_statistic((s**2 / len(values))[2:]))


def test_pca_finds_planted(matrix):
    normal = matrix.where("label = 0")
    flags = pca.fit_pca(normal, COLUMNS, components=0.9, weighting="none").transform(matrix)
    precision, recall = quality(flags)
    assert recall > 0.9 and precision > 0.5


def test_invariants(matrix):
    model = invariants.fit_invariants(matrix, COLUMNS, keep=0.9)
    assert ("E1", "E2", 3, -1) in model.invariants and min(model.support) >= 0.9
    assert len(model.invariants) <= model.dimension
    precision, recall = quality(model.transform(matrix))
    assert precision == 1.0 and recall == 1.0


@pytest.mark.parametrize("x, expected", [
    ([[1, 3], [2, 6]], (3, -1)), ([[8, 1], [16, 2]], (1, -8)), ([[5, 5], [7, 7]], (1, -1)), ([[0, 0]], None), ([[3, 0]], None)])
def test_pair_factors(x, expected):
    x = np.array(x, float)
    g = x.T @ x
    assert invariants.pair_factors(g[0, 0], g[0, 1], g[1, 1]) == expected


def test_clusters(matrix):
    normal = matrix.where("label = 0")
    model = clustering.fit_clusters(normal, COLUMNS, max_distance=0.02, weighting="none")
    assert model.transform(normal).where("pred = 1").count() == 0
    precision, recall = quality(model.transform(matrix))
    assert precision == 1.0 and recall > 0.9
    assert 1 < model.rounds <= clustering.COARSE + 1 and model.offline == model.centres.count()


@pytest.fixture(scope="module")
def directions(spark):
    """Twelve hundred vectors without any pattern, one of them two hundred times."""
    values = np.random.default_rng(0).integers(0, 7, (1200, 6))
    values = np.vstack([values, np.repeat(values[:1], 200, axis=0)])
    columns = [f"E{n}" for n in range(6)]
    return spark.createDataFrame(pd.DataFrame(values, columns=columns)).persist(), columns


@pytest.mark.parametrize("max_distance", [0.3, 0.02, 0.0])
def test_every_vector_is_near_a_centre_and_the_nearest_is_found(directions, max_distance, monkeypatch):
    """Against all distances; small blocks, so that cells are cut on both sides."""
    rows, columns = directions
    monkeypatch.setattr(clustering, "BLOCK_BYTES", 4_000)
    model = clustering.fit_clusters(rows, columns, max_distance=max_distance, weighting="none")
    found = model.transform(rows).toPandas()
    centres = model.centres.orderBy("cluster").collect()
    units = clustering.unit_rows(found[columns].to_numpy(float), np.ones(6))
    distance = 1.0 - units @ np.array([r.unit for r in centres]).T
    assert np.allclose(found.score, distance.min(axis=1), atol=1e-12) and found.pred.sum() == 0
    assert model.rounds <= clustering.COARSE + 1
    assert (max_distance == 0.3) == (len(centres) <= clustering.PIVOTS)


def test_triangle_inequality_leaves_cells_out(directions):
    rows, columns = directions
    model = clustering.fit_clusters(rows, columns, max_distance=0.0, weighting="none")
    index = clustering.CentreIndex.of(model.centres)
    asked = model.centres.limit(500).select(F.col("cluster").alias("id"), "unit")
    units = np.array([r.unit for r in asked.collect()])
    open_ = index.may_hold(clustering._angles(units, index.pivots), np.full(len(units), 0.05))
    assert open_.any(axis=1).all() and open_.mean() < 0.5


def test_clusters_take_in_new_sessions_and_are_kept(directions, tmp_path):
    rows, columns = directions
    first, later = rows.where("E0 < 4"), rows.where("E0 >= 4")
    model = clustering.fit_clusters(first, columns, max_distance=0.01, weighting="none")
    assert model.transform(later).where("pred = 1").count() > 0
    model.save(str(tmp_path / "m"))
    grown = clustering.ClusterDetector.load(str(tmp_path / "m")).updated(later)
    assert grown.offline == model.offline and grown.online > 0 and grown.centres.count() == grown.offline + grown.online
    assert grown.transform(rows).where("pred = 1").count() == 0
    assert grown.updated(later).online == grown.online
    held = grown.summaries(rows).agg(F.sum("sessions"), F.max("width")).first()
    assert held[0] == rows.count() and held[1] <= 0.01 + 1e-9
    empty = clustering.fit_clusters(rows.limit(0), columns)
    assert empty.offline == 0 and empty.transform(rows.limit(3)).where("pred = 1").count() == 3
    assert empty.updated(first).online > 0


def test_forest(matrix):
    model = forest.fit_forest(matrix, COLUMNS, "block_id", trees=50, sample=128, contamination=0.06)
    flags = model.transform(matrix)
    precision, recall = quality(flags)
    assert recall > 0.8 and precision > 0.6
    again = forest.fit_forest(matrix.repartition(7), COLUMNS, "block_id", trees=50, sample=128, contamination=0.06)
    assert again.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        model.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    assert model.nodes.groupby("tree").size().max() <= 2 * 128 - 1 and model.nodes.tree.nunique() == 50


def test_average_path():
    assert forest.average_path(1) == 0.0 and forest.average_path(2) == 1.0
    assert forest.average_path(256) == pytest.approx(10.2447, abs=1e-3)


@pytest.mark.parametrize("kind", sorted(supervised.KINDS))
def test_supervised(matrix, kind):
    precision, recall = quality(supervised.fit_supervised(matrix, COLUMNS, "label", kind).transform(matrix))
    assert precision > 0.95 and recall > 0.95


def test_fitted_detectors_are_kept(spark, matrix, tmp_path):
    """What was fitted on one day scores the next."""
    fitted = {
        "pca": pca.fit_pca(matrix, COLUMNS, components=2), "invariants": invariants.fit_invariants(matrix, COLUMNS, keep=0.9),
        "clusters": clustering.fit_clusters(matrix, COLUMNS, max_distance=0.02),
        "forest": forest.fit_forest(matrix, COLUMNS, "block_id", trees=10, sample=64),
        **{kind: supervised.fit_supervised(matrix, COLUMNS, "label", kind) for kind in supervised.KINDS}}
    for name, model in fitted.items():
        for _ in range(2):  # replaced when saved again
            model.save(str(tmp_path / name))
        again = type(model).load(str(tmp_path / name))
        columns = ["block_id", "score", "pred"]
        assert sorted(map(tuple, again.transform(matrix).select(columns).collect())) == sorted(
            map(tuple, model.transform(matrix).select(columns).collect())), name
    events = spark.createDataFrame([(f"b{n}", k, e) for n in range(5) for k, e in enumerate("abcab")], "block_id string, line_id bigint, event string")
    model = next_event.fit_next_events(events, "block_id", ["line_id"], "event", history=2, g=1)
    model.save(str(tmp_path / "next"))
    again = next_event.NextEventDetector.load(str(tmp_path / "next"))
    assert again.limits == model.limits and again.transform(events).collect() == model.transform(events).collect()


def test_report(matrix):
    found = report.benchmark_report(matrix, COLUMNS, "block_id", "label", contamination=0.05, max_distance=0.1).collect()
    assert len(found) == 14 and {r.split for r in found} == {"train", "test"}
    assert all(r.f1 > 0.9 for r in found if r.detector in supervised.KINDS)


def test_next_events(spark):
    def trace(name, events):
        return [(name, n, e) for n, e in enumerate(events)]
    data = [r for n in range(20) for r in trace(f"n{n}", "abcabcabc")] + trace("odd", "abcacb") + trace("short", "a")
    events = spark.createDataFrame(data, "block_id string, line_id bigint, event string")
    normal = events.where(F.col("block_id").startswith("n"))
    model = next_event.fit_next_events(normal, "block_id", ["line_id"], "event", history=2, g=1)
    flags = {r.block_id: (r.pairs, r.unexpected, r.pred) for r in model.transform(events).collect()}
    assert flags["odd"] == (4, 2, 1) and flags["short"] == (0, 0, 0) and flags["n0"] == (7, 0, 0)


def test_terms(spark):
    row = spark.createDataFrame([([0, 0, 5, 6, 7],)], "t array<bigint>").select(sequence.trace_terms(F.col("t"))).first()[0]
    assert row == ["e5", "e6", "e7", "last7", "d1_5_6", "d1_6_7", "d2_5_7"]


def test_selection(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [(f"s{n:03d}", [0, 0, *([3, 4, 5] if n % 4 else [4, 3, 5])], int(n % 4 == 0)) for n in rng.permutation(200).tolist()]
    traces = spark.createDataFrame(data, "block_id string, tokens array<bigint>, y int")
    found, scores = sequence.select_model(traces, "block_id", str(tmp_path / "m"), regs=(10.0, 0.001))
    found = found.collect()
    assert [(r.epoch, r.split) for r in found] == [(1, "train"), (1, "val"), (2, "train"), (2, "val"), (2, "test")]
    assert found[-1].accuracy == 1.0
    assert sum(found[-1][2:6]) == 20 == scores.count()
    # Without validation rows the last setting stays, and no row is reported over no data.
    found, _ = sequence.select_model(traces, "block_id", str(tmp_path / "n"), regs=(0.001, 10.0), val_frac=0.0, test_frac=0.0)
    assert [(r.epoch, r.split) for r in found.collect()] == [(1, "train"), (2, "train")]


def test_saved_classifier_scores_raw_events(spark, tmp_path):
    events = spark.createDataFrame(
        [(f"s{n:02d}", k, e) for n in range(40) for k, e in enumerate("abc" if n % 2 else "acb")], "block_id string, line_id bigint, event_id string")
    codes = encode.lexical_rank(events).withColumn("code", F.col("code") + 1)
    tokens = sequences.padded_tokens(
        encode.join_codes(events, codes).withColumn("t", F.col("code") + 1), "block_id", ["line_id"], "t", 8)
    rows = tokens.withColumn("y", (F.substring("block_id", 2, 2).cast("int") % 2))
    sequence.fit_sequence(rows, threshold=0.4, length=8, codes=codes).save(str(tmp_path / "m"))
    loaded = sequence.SequenceClassifier.load(str(tmp_path / "m"))
    assert (loaded.threshold, loaded.length, loaded.codes.count()) == (0.4, 8, 3)
    odd = spark.createDataFrame([("x1", 0, "a"), ("x1", 1, "b"), ("x1", 2, "c"), ("x0", 0, "new")], events.schema)
    flags = {r.block_id: r.pred for r in loaded.score_events(events.unionByName(odd), "block_id", ["line_id"]).collect()}
    assert flags["x1"] == 1 and "x0" in flags and all(flags[f"s{n:02d}"] == n % 2 for n in range(40))


def test_terms_do_not_collide(spark):
    data = [(f"s{n}", [a, b], 0) for n, (a, b) in enumerate((a, b) for a in range(1, 31) for b in range(1, 31))]
    traces = spark.createDataFrame(data, "block_id string, tokens array<bigint>, y int")
    shapes = sequence.shapes_of(traces, "y")
    terms = sequence.term_index(shapes)
    found = terms.orderBy("code").collect()
    assert [r.code for r in found] == list(range(30 + 30 + 900)) and [r.term for r in found] == sorted(r.term for r in found)
    vectors = sequence.vectorise(shapes, terms)
    assert vectors.select("codes").distinct().count() == 900 == vectors.count()
    assert sequence.term_index(shapes, min_count=30).count() == 60


def test_all_settings_are_fitted_at_once(spark, monkeypatch):
    """Losses at the optimum against a plain fit of each setting, and no more passes than the slowest one takes."""
    rng = np.random.default_rng(4)
    data = [(rng.integers(0, 4, 5).tolist(), int(rng.random() < 0.3)) for _ in range(400)]
    traces = spark.createDataFrame(data, "tokens array<bigint>, y int")
    passes = []
    plain = sequence._losses
    monkeypatch.setattr(sequence, "_losses", lambda rows, label, points: passes.append(len(points)) or plain(rows, label, points))
    regs = (0.1, 0.01, 0.001)
    models = sequence.fit_all(traces, "y", regs)
    assert passes[0] == 3 and len(passes) < 60
    rows = traces.select("tokens", "y", sequence.trace_terms(F.col("tokens")).alias("terms")).collect()
    names = sorted({t for r in rows for t in r.terms})
    x = np.array([[r.terms.count(t) for t in names] for r in rows], float)
    y = np.array([r.y for r in rows])
    scale = x.std(axis=0)

    def loss(weights, constant, reg):
        sign = 2 * y - 1
        return np.logaddexp(0, -sign * (x @ weights + constant)).mean() + reg / 2 * ((weights * scale) ** 2).sum()

    for reg, model in zip(regs, models):
        own = {r.term: r.weight for r in model.weights.collect()}
        weights = np.array([own[t] for t in names])
        best = loss(weights, model.constant, reg)
        for _ in range(60):  # no direction leads further down
            step = rng.normal(size=len(names)) * 1e-3
            assert loss(weights + step, model.constant, reg) > best - 1e-5
        prob = {tuple(r.tokens): r.prob for r in model.transform(traces).collect()}
        want = 1 / (1 + np.exp(-(x @ weights + model.constant)))
        assert np.allclose([prob[tuple(r.tokens)] for r in rows], want)


def test_report_finds_broken_relations(spark):
    """A floor for every detector: anomalies that break a relation must show."""
    rows = V.paired_counts(spark, "/root/testdata/sf0.01")
    halves = split.stratified_split(rows, "session", "y")
    found = report.benchmark_report(halves, V.PAIRED_EVENTS, "session", "y", contamination=0.1, max_distance=0.0, settings={
        "pca": {"components": 1, "weighting": "none", "threshold": 0.5}, "log_clustering": {"weighting": "none"}, "invariant_miner": {"keep": 0.8}})
    recall = {(r.detector, r.split): r.recall for r in found.collect()}
    floors = {"pca": 0.9, "invariant_miner": 1.0, "log_clustering": 1.0, "isolation_forest": 0.1, "logistic_regression": 0.95,
              "linear_svm": 0.9, "decision_tree": 0.8}
    assert {k[0] for k in recall} == set(floors) and len(recall) == 14
    assert all(value >= floors[name] for (name, _), value in recall.items()), recall
