"""Distributed ranks equal global windows, whatever the skew."""

import pytest
from conftest import rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logspark.operators import selection, split
from logspark.operators.rank import running_totals


@pytest.fixture(scope="module")
def scores(spark):
    """Two thirds of the rows share one score."""
    return spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, F.rand(5)).otherwise(0.5).alias("prob"), (F.col("id") % 7 == 0).cast("int").alias("y"),
        F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 2 == 0, "a").otherwise("hot").alias("kind")).persist()


@pytest.mark.parametrize("ranges", [1, 5, 32])
def test_running_sums(scores, ranges):
    window = W.orderBy(F.desc("prob"), "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    want = scores.select("id", F.count(F.lit(1)).over(window).alias("rank"), F.sum("y").over(window).alias("hits"))
    got = running_totals(scores, [F.desc("prob"), F.col("id")], sums={"hits": F.col("y")}, ranges=ranges)
    assert rows(got.select("id", "rank", "hits")) == rows(want)
    assert {(r.total, r.total_hits) for r in got.collect()} == {(2000, 286)}


def test_ranks_in_groups(scores):
    window = W.partitionBy("kind").orderBy("prob", "id")
    want = scores.select("id", F.row_number().over(window).cast("bigint").alias("rank"), F.count(F.lit(1)).over(W.partitionBy("kind")))
    assert rows(running_totals(scores, [F.col("prob"), F.col("id")], within=["kind"]).select("id", "rank", "total")) == rows(want)


def test_shuffle_does_not_depend_on_partitions(scores):
    first = [r.id for r in split.seeded_shuffle(scores, "id", 7).collect()]
    again = [r.id for r in split.seeded_shuffle(scores.repartition(13), "id", 7).collect()]
    assert first == again and first != sorted(first) and sorted(first) == list(range(2000))
    assert first != [r.id for r in split.seeded_shuffle(scores, "id", 8).collect()]


def test_caps(scores):
    want = rows(scores.orderBy(split.shuffle_key("id", 7), "id").limit(100))
    assert rows(split.cap_traces(scores.repartition(9), "id", 100, 7)) == want
    assert split.cap_traces(scores, "id", 5000, 7).count() == 2000 and split.cap_traces(scores, "id", 0, 7).count() == 0


def test_splits_shuffle_no_rows(scores):
    for parts in (split.positional_split(scores, "id"), split.stratified_split(scores, "id", "y"), split.cap_traces(scores, "id", 9)):
        plan = parts._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "TakeOrdered" not in plan


@pytest.mark.parametrize("seed", [None, 3])
@pytest.mark.parametrize("kind", ["number", "text", "date", "holes"])
def test_place_is_found_bin_by_bin(spark, seed, kind, monkeypatch):
    """Against a sort, with bins of a few rows; no pass sorts or moves the table."""
    monkeypatch.setattr(selection, "SMALL", 20)
    monkeypatch.setattr(selection, "BINS", 6)
    monkeypatch.setattr(selection, "BITS", 3)
    keys = spark.range(700).select({
        "number": F.col("id") * 3 - 900, "text": F.concat(F.lit("blk_-"), F.col("id") * 7919 % 1009, F.lit("é")),
        "date": F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")),
        "holes": F.when(F.col("id") % 2 == 0, F.col("id"))}[kind].alias("key")).repartition(3).persist()
    order = [tuple(r[0]) for r in keys.select(split.place_of("key", seed)).orderBy(*split.order_of("key", seed)).collect()]
    for rank in (1, 2, 333, 350, 351, 699, 700):
        assert tuple(selection.place_at(keys, "key", seed, rank, 700)) == order[rank - 1]
    keys.unpersist()


def test_a_key_that_repeats_stays_together(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 20)
    keys = spark.range(500).select(F.when(F.col("id") < 400, F.lit("same")).otherwise(F.col("id").cast("string")).alias("key"))
    for seed in (None, 3):
        assert split.cap_traces(keys, "key", 450, seed).count() in range(400, 501)


def test_input_is_worked_out_once(spark):
    """A column that differs in each evaluation is the same in borders and rows."""
    once = spark.range(1000).select(F.rand().alias("id"), F.lit(0).alias("y"))
    halves = split.stratified_split(once, "id", "y", seed=None)
    top = halves.groupBy("split").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    found = {r.split: r for r in top.collect()}
    assert found["train"].n == found["test"].n == 500 and found["train"].high < found["test"].low


def test_positional_split(scores):
    sizes = {r.split: r["count"] for r in split.positional_split(scores.limit(25), "id", 0.1, 0.3).groupBy("split").count().collect()}
    assert sizes == {"train": 16, "val": 2, "test": 7}
    sizes = {r.split for r in split.positional_split(scores.limit(5), "id", 0.1, 0.1).select("split").distinct().collect()}
    assert sizes == {"train"}
    with pytest.raises(ValueError):
        split.positional_split(scores, "id", 0.5, 0.5)


def test_stratified_split(scores):
    halves = split.stratified_split(scores, "id", "y").groupBy("split", "y").count()
    assert {(r.split, r.y): r["count"] for r in halves.collect()} == {
        ("train", 1): 143, ("test", 1): 143, ("train", 0): 857, ("test", 0): 857}
