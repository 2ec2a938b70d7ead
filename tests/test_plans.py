"""The four flows from end to end, and the stream against the batch."""

import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logspark.detectors.next_event import top_followers
from logspark.operators import encode, features, parse, sequences, sessions
from logspark.operators.skew import Limits
from logspark.plans import benchmark, classifier, dataset, next_event
from logspark.sources import datasets, logs
from logspark.streaming.logs import run_to_end, sessions_by_gap, stream_events, unexpected_pairs, untimed
from logspark.workload import views as V

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Dataset A built from text files, and what it must hold."""
    home = tmp_path_factory.mktemp("plans")
    V.raw_logs(spark, FOLDER).repartitionByRange(3, "line_id").sortWithinPartitions("line_id").select("value").write.text(f"{home}/log")
    V.block_labels(spark, FOLDER).select(F.col("block_id").alias("BlockId"), F.col("label").alias("Label")).coalesce(1).write.csv(
        f"{home}/labels", header=True)
    counters = dataset.build_dataset(spark, f"{home}/log", f"{home}/out", f"{home}/labels")
    return home, {r.counter: r.value for r in counters.collect()}


def test_dataset(spark, built):
    home, counters = built
    events = V.events(spark, FOLDER)
    tuples, labels = sessions.session_tuples(events), V.block_labels(spark, FOLDER)
    assert counters["lines"] == events.count() and counters["labels"] == labels.count()
    assert counters["sessions"] == tuples.select("block_id").distinct().count()

    traces = spark.read.csv(f"{home}/out/traces", header=True, escape='"')
    want = sessions.trace_features(tuples, labels).select(
        "block_id", F.col("segment").cast("string"), "label", F.col("type").cast("string"), "features", "time_interval", F.col("latency").cast("string"))
    assert rows(traces) == rows(want)
    assert [r[0] for r in traces.coalesce(1).collect()] == sorted(r[0] for r in traces.collect())

    ids = features.observed_events(events)
    matrix = spark.read.csv(f"{home}/out/matrix", header=True)
    assert matrix.columns == ["BlockId", *ids]
    sequences_ = datasets.load_traces(spark, f"{home}/out/sequences")
    assert sequences_.select(F.sum(F.size("x_data"))).first()[0] == tuples.count()
    assert spark.read.csv(f"{home}/out/labels", header=True).count() == counters["sessions"]
    templates = spark.read.csv(f"{home}/out/templates", header=True, escape='"')
    assert rows(templates.select("EventId", F.col("Occurrences").cast("bigint"))) == rows(
        parse.template_stats(events).select("event_id", "occurrences"))


def test_long_sessions_keep_their_tail(spark, built):
    home, _ = built
    table = spark.read.parquet(f"{home}/out/events")
    tuples, labels = dataset.tuples_of(table), V.block_labels(spark, FOLDER)
    codes = encode.event_rank(table)
    whole = classifier.fixed_traces(dataset.encoded_sequences(tuples, labels, codes), 20)
    cut = classifier.fixed_traces(dataset.encoded_sequences(tuples, labels, codes, Limits(max_events=3)), 20)
    assert rows(cut) == rows(whole)


def test_classifier(spark, built):
    home, counters = built
    found = classifier.train_classifier(spark, f"{home}/out/sequences", f"{home}/model", length=16, max_traces=60, regs=(0.1, 0.01))
    assert [r.split for r in found.collect()] == ["train", "val", "train", "val", "test"]
    sizes = [sum(r[2:6]) for r in found.collect()]
    assert sizes[-1] == int(0.1 * counters["sessions"]) == spark.read.parquet(f"{home}/model/curve/summary").first().n
    assert spark.read.parquet(f"{home}/model/curve/points").count() >= 2


def test_next_event(spark, built):
    home, _ = built
    events = V.events(spark, FOLDER)
    events.select(F.col("line_id").alias("LineId"), F.col("content").alias("Content"), F.col("event_id").alias("EventId")).write.csv(
        f"{home}/structured", header=True, escape='"')
    row = next_event.next_event_accuracy(
        logs.load_structured(spark, f"{home}/structured"), V.block_labels(spark, FOLDER), history=1, g=29).first()
    keyed = sessions.first_block_tuples(events).select("block_id").distinct().count()
    assert row.normal + row.abnormal == keyed and row.tn + row.fp == row.normal and 0.0 <= row.accuracy <= 1.0


def test_benchmark(spark):
    days = V.daily_counts(spark, FOLDER).withColumnRenamed("session", "block_id")
    summary, found = benchmark.run_benchmark(
        days.drop("y"), days.select("block_id", F.col("y").alias("label")), V.DAILY_EVENTS, contamination=0.08)
    assert found.count() == 14
    assert summary.where("split = 'total'").first().instances == days.count()


def test_stream_equals_batch(spark, tmp_path):
    V.raw_logs(spark, FOLDER).select("value").repartition(3).write.text(str(tmp_path / "log"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run_to_end(stream_events(spark, str(tmp_path / "log")), out, state)
    run_to_end(stream_events(spark, str(tmp_path / "log")), out, state)  # nothing new, nothing twice
    columns = ["content", "event_id", "event_template", "ts"]
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(columns)) == rows(V.events(spark, FOLDER).select(columns))


def test_stream_scoring(spark, tmp_path):
    pairs = sequences.next_event_pairs(V.event_traces(spark, FOLDER), "session", ["line_id"], "event", 1)
    pairs.write.parquet(str(tmp_path / "pairs"))
    followers = top_followers(pairs, 3).persist()
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "pairs"))
    query = unexpected_pairs(stream, followers).writeStream.format("memory").queryName("odd_pairs").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = pairs.join(followers, ["context", "next"], "left_anti")
    assert rows(spark.table("odd_pairs").select(want.columns)) == rows(want)


def test_sessions_on_a_stream_in_several_runs(spark, tmp_path):
    """Open sessions stay in state over runs, closed ones come out once, late rows are counted, rows without time are set apart."""
    schema = "user string, ts timestamp, n int"
    at = lambda hour, minute=0: datetime.datetime(2024, 1, 1, hour, minute)
    days = [[("a", at(1), 1), ("a", at(1, 20), 2), ("b", at(1, 10), 3), (None, at(1), 4), ("a", None, 5)],
            [("a", at(1, 45), 6), ("b", at(5), 7)], [("a", at(1, 5), 8), ("b", at(9), 9)]]
    out, state, late = str(tmp_path / "out"), str(tmp_path / "state"), []
    for n, day in enumerate(days):
        spark.createDataFrame(day, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        late.append(run_to_end(sessions_by_gap(stream, "user", "30 minutes", "1 hour", last=F.max("n")), out, state))
    got = sorted((r.user, r.start.hour, r.start.minute, r.events, r.last) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, 0, 3, 6), ("b", 1, 10, 1, 3), ("b", 5, 0, 1, 7)] and late == [0, 0, 1]
    table = spark.createDataFrame(sum(days, []), schema)
    assert untimed(table, "user").count() == 2
    batch = sessions_by_gap(table, "user", "30 minutes", "1 hour", last=F.max("n"))
    assert batch.count() == 4 and batch.agg(F.sum("events")).first()[0] == 7
