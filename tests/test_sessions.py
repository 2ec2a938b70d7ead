"""Sessions do not depend on partitioning, and cutting long ones loses nothing."""

from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.operators import features, sequences, sessions
from logspark.operators.skew import Limits
from logspark.workload import views as V

FOLDER = "/root/testdata/sf0.001"
TUPLES = "block_id string, line_id bigint, pos int, event_id string, ts timestamp"


@pytest.fixture(scope="module")
def tuples(spark):
    df = V.tuples(spark, FOLDER).persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def hot(spark):
    """One session with more than half of all events."""
    ids = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("blk_"), F.col("id") % 50)).otherwise("blk_hot").alias("block_id"),
        F.col("id").alias("line_id"), F.lit(0).alias("pos"),
        F.concat(F.lit("E"), (F.col("id") * 7 % 30).cast("string")).alias("event_id"),
        F.when(F.col("id") % 11 != 0, F.timestamp_seconds(F.col("id") * 17 % 5000)).alias("ts"))
    return ids.persist()


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_features_do_not_depend_on_partitions(spark, tuples, partitions):
    labels = V.block_labels(spark, FOLDER)
    want = rows(sessions.trace_features(tuples, labels))
    shuffled = tuples.orderBy(F.rand(partitions)).repartition(partitions)
    assert rows(sessions.trace_features(shuffled, labels)) == want


def joined(found):
    """Segments of each session put together again."""
    groups = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.block_id, r.segment)):
        groups[r.block_id].append(r)
    result = {}
    for block, parts in groups.items():
        gaps = "[" + ", ".join(p.time_interval[1:-1] for p in parts if p.time_interval != "[]") + "]"
        if any(p.time_interval == "[0.0]" and len(parts) == 1 for p in parts):
            gaps = parts[0].time_interval
        assert len({p.label for p in parts}) == 1
        assert {(p.type, p.latency) for p in parts[1:]} <= {(None, None)}
        result[block] = ("[" + ",".join(p.features[1:-1] for p in parts) + "]", gaps, parts[0].type, parts[0].latency)
    return result


@pytest.mark.parametrize("limit", [1, 7, 100, 999])
def test_cut_features_put_together_are_the_whole(spark, hot, limit):
    labels = spark.createDataFrame([("blk_hot", 1)], "block_id string, label int")
    whole = sessions.trace_features(hot, labels).collect()
    cut = sessions.trace_features(hot, labels, limits=Limits(max_events=limit)).collect()
    assert len(cut) > len(whole)
    assert max(r.features.count(",") + 1 for r in cut) <= limit
    assert joined(cut) == joined(whole)


def test_many_long_keys_are_joined_instead_of_sent(spark, hot):
    few = sessions.build_sessions(hot, Limits(max_events=10)).select("block_id", "segment", F.size("events"))
    many = sessions.build_sessions(hot, Limits(max_events=10, max_keys=3)).select("block_id", "segment", F.size("events"))
    assert rows(few) == rows(many)
    assert sum(r[2] for r in few.collect()) == 3000


@pytest.mark.parametrize("limit", [8, 50])
def test_windows_over_cut_sessions(hot, limit):
    limits = Limits(max_events=limit)
    order = ["line_id", "pos"]
    coded = hot.withColumn("token", F.substring("event_id", 2, 9).cast("bigint"))
    for whole, cut in [
        (sessions.event_gaps(hot), sessions.event_gaps(hot, limits)),
        (sequences.dilated_lags(coded, "block_id", order, "token"),
         sequences.dilated_lags(coded, "block_id", order, "token", limits=limits)),
        (sequences.next_event_pairs(hot, "block_id", order, "event_id", 4),
         sequences.next_event_pairs(hot, "block_id", order, "event_id", 4, limits)),
    ]:
        assert rows(cut.select(whole.columns)) == rows(whole)


def test_look_back_beyond_a_segment_is_refused(hot):
    with pytest.raises(ValueError):
        sequences.next_event_pairs(hot, "block_id", ["line_id"], "event_id", 9, Limits(max_events=8))


def one_session(spark, events):
    return spark.createDataFrame([("b", n, 0, e, t) for n, (e, t) in enumerate(events)], "a string, b bigint, c int, d string, e bigint").select(
        F.col("a").alias("block_id"), F.col("b").alias("line_id"), F.col("c").alias("pos"), F.col("d").alias("event_id"),
        F.timestamp_seconds("e").alias("ts"))


@pytest.mark.parametrize("events, type_, features_, gaps, latency", [
    ([("E5", 10)], None, "[E5]", "[0.0]", 0),
    ([("E5", None), ("E4", None)], 1, "[E5,E4]", "[0.0]", 0),
    ([("E5", None), ("E4", 7), ("E4", None)], 2, "[E5,E4,E4]", "[0.0]", 0),
    ([("E5", 10), ("E6", 4), ("E9", None), ("E1", 5)], None, "[E5,E6,E9,E1]", "[-6.0, 0.0, 0.0]", -5),
])
def test_small_sessions(spark, events, type_, features_, gaps, latency):
    labels = spark.createDataFrame([], "block_id string, label int")
    row = sessions.trace_features(one_session(spark, events), labels).first()
    assert tuple(row) == ("b", 0, "Success", type_, features_, gaps, latency)
    assert features.latencies(one_session(spark, events)).first().latency == latency
    assert features.error_counts(one_session(spark, events)).first().type == type_


def test_empty_input(spark):
    empty = spark.createDataFrame([], TUPLES)
    labels = spark.createDataFrame([], "block_id string, label int")
    assert sessions.trace_features(empty, labels).count() == 0
    assert sessions.event_gaps(empty).count() == 0
    assert features.occurrence_matrix(empty, ["E1"]).count() == 0


def test_label_two_is_success_but_kept(spark):
    labels = spark.createDataFrame([("b", 2)], "block_id string, label int")
    one = one_session(spark, [("E5", 10)])
    assert sessions.trace_features(one, labels).first().label == "Success"
    assert sessions.label_sessions(one, labels).first().label == 2


def test_matrix_and_long_form_agree(tuples):
    events = features.observed_events(tuples)
    matrix = features.occurrence_matrix(tuples, events)
    long_form = features.unpivot_matrix(matrix, events).withColumn("n", F.col("n").cast("bigint"))
    assert rows(long_form) == rows(features.event_counts(tuples))


def test_tails(spark, hot):
    tail = sequences.last_n_events(hot, "block_id", ["line_id", "pos"], 5)
    assert tail.groupBy("block_id").count().agg(F.max("count")).first()[0] == 5
    coded = hot.withColumn("token", F.substring("event_id", 2, 9).cast("bigint"))
    got = {r.block_id: r.tokens for r in sequences.padded_tokens(coded, "block_id", ["line_id"], "token", 70).collect()}
    ordered = defaultdict(list)
    for r in coded.orderBy("line_id").collect():
        ordered[r.block_id].append(r.token)
    for block, tokens in ordered.items():
        assert got[block] == ([0] * 70 + tokens)[-70:]


def test_long_tails_of_a_hot_session(spark):
    """No window over a session: one of them has nearly all rows."""
    events = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, (F.col("id") % 7).cast("string")).otherwise("hot").alias("block_id"),
        F.xxhash64("id").alias("line_id"), F.col("id").alias("event"))
    got = sequences.last_n_events(events, "block_id", ["line_id"], 5_000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "block_id" not in "".join(line for line in plan.split("\n") if "Window" in line)
    last = W.partitionBy("block_id").orderBy(F.desc("line_id"))
    want = events.withColumn("from_end", F.row_number().over(last)).where("from_end <= 5000")
    assert rows(got) == rows(want) and got.dtypes == want.dtypes and got.where("block_id = 'hot'").count() == 5_000
