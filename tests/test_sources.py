"""Files: line numbers, odd bytes, label rules, and writers read back."""

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from logspark.operators import parse
from logspark.sources import datasets, logs, sinks


def test_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\r\ntwo \n\nbad \xff\xfe byte\nlast")
    values = [r.value for r in logs.number_lines(spark, str(tmp_path)).orderBy("line_id").collect()]
    assert values == ["one", "", "two ", "", "bad �� byte", "last"]
    assert sorted(r.value for r in logs.scan_log_lines(spark, str(tmp_path)).collect()) == sorted(values)


@pytest.mark.parametrize("split_bytes", ["64", "1000", "134217728"])
def test_line_numbers_over_files_and_splits(spark, tmp_path, split_bytes):
    want = []
    for name, count in (("b", 400), ("a", 3), ("d", 0), ("c", 90)):
        (tmp_path / f"{name}.log").write_text("".join(f"{name}{n}\n" for n in range(count)))
    for name, count in (("a", 3), ("b", 400), ("c", 90)):
        want += [f"{name}{n}" for n in range(count)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = logs.number_lines(spark, str(tmp_path)).orderBy("line_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line_id for r in got] == list(range(1, len(want) + 1))
    assert [r.value for r in got] == want


def test_byte_order_mark_is_dropped(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbf081109 203518 1 INFO a: text\n")
    assert parse.parse_lines(logs.number_lines(spark, str(tmp_path))).first().content == "text"


@pytest.mark.parametrize("names, expected", [
    (["BlockId", "Label"], ("BlockId", "Label")), ([" block_id ", " ANOMALY"], (" block_id ", " ANOMALY")),
    (["Label", "SessionID"], ("SessionID", "Label")), (["valid", "label", "BlockId"], ("valid", "label"))])
def test_label_columns(names, expected):
    assert datasets.label_columns(names) == expected


def test_label_columns_must_exist():
    with pytest.raises(ValueError):
        datasets.label_columns(["a", "label"])


def test_labels(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("BlockId,Label\nblk_1,0\nblk_2,Anomaly\nblk_1,1\nblk_3,Normal\n")
    assert rows(datasets.load_labels(spark, str(path))) == [("blk_1", 1), ("blk_2", 1), ("blk_3", 0)]
    assert datasets.load_labels(spark, None).count() == 0
    assert datasets.load_labels(spark, str(tmp_path / "absent.csv")).count() == 0


def test_structured(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('LineId,Content,EventId\n1,"a, ""quoted"" text",E5\n2,plain,E6\n')
    assert rows(logs.load_structured(spark, str(path))) == [(1, 'a, "quoted" text', "E5"), (2, "plain", "E6")]
    (tmp_path / "t.csv").write_text("Content\nx\n")
    with pytest.raises(ValueError):
        logs.load_structured(spark, str(tmp_path / "t.csv"))


def test_traces_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        datasets.check_traces(spark.createDataFrame([([1],)], "x_data array<int>"))
    bad = spark.createDataFrame([([1], 0), ([2], None)], "x_data array<int>, y_data int")
    with pytest.raises(PySparkException):
        datasets.check_traces(bad).collect()


def test_splits(spark, tmp_path):
    data = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "id int, split string")
    datasets.write_splits(data, str(tmp_path / "d"))
    found = datasets.load_splits(spark, str(tmp_path / "d"))
    assert rows(found["train"]) == [(1,), (2,)] and rows(found["test"]) == [(3,)] and found["val"] is None
    plan = found["train"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    datasets.write_splits(data.where("split = 'test'"), str(tmp_path / "e"))
    with pytest.raises(ValueError):
        datasets.load_splits(spark, str(tmp_path / "e"))


@pytest.mark.parametrize("schema, expected", [
    ("x array<int>, y int", {"x": "array<bigint>", "y": "bigint"}),
    ("x array<array<double>>, y double", {"x": "array<array<float>>", "y": "float"}),
    ("x array<array<short>>", {"x": "array<array<bigint>>"})])
def test_typed_dataset(spark, schema, expected):
    assert dict(datasets.typed_dataset(spark.createDataFrame([], schema)).dtypes) == expected


@pytest.mark.parametrize("schema", ["x int", "x array<array<array<int>>>", "x array<string>"])
def test_other_ranks_are_refused(spark, schema):
    with pytest.raises(ValueError):
        datasets.typed_dataset(spark.createDataFrame([], schema))


def test_csv_text_is_kept(spark, tmp_path):
    text = ' lead, "quotes" and trail '
    stats = spark.createDataFrame([("E0", text, 2), ("E10", "b", 1), ("E9", "a", 1), ("odd", "c", 1)],
                                  "event_id string, event_template string, occurrences bigint")
    sinks.write_templates(stats, str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"), header=True, escape='"')
    assert back.columns == ["EventId", "EventTemplate", "Occurrences"]
    assert [r.EventId for r in back.coalesce(1).collect()] == ["E0", "E9", "E10", "odd"]
    assert back.where(F.col("EventId") == "E0").first().EventTemplate == text
    with pytest.raises(PySparkException):
        sinks.write_templates(stats, str(tmp_path / "t"))
