"""Parsing and matching against a plain statement of the rules."""

import re

import random

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from logspark.functions import catalog
from logspark.functions import columns as C
from logspark.operators import parse

HEADER = re.compile(r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([\w.$]+):\s+(.+)$")
PATTERNS = [(e, re.compile(catalog.pattern(t), re.IGNORECASE)) for e, t in catalog.TEMPLATES.items()]

LINES = [
    "", " ", "no header at all", "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_1 src: a dest: b",
    "081109 203518 143 INFO dfs.DataNode: ", "081109 203518 143 INFO a: b: c", "081109  203518\t143 INFO a:  x ",
    "０８１１０９ 203518 1 INFO a: full width digits", "081109 203518 1 INF́O a: combining mark",
    "081109 203518 1 INFO a: line\u0085separator blk_2", "081109 203518 1 INFO a: no-break space",
    "081109\x1c203518 1 INFO a: file separator", "x 081109 203518 1 INFO a: late", "081109 203518 1 INFO a: \u0001odd\u0001",
    "VERIFICATION SUCCEEDED FOR blk_3", "verification ſucceeded for blk_4", "Reopen BlocK blk_5",
    "Served block to", "Served blockto", "Served block  to", "PacketResponder Exception for block terminating",
    "Received block src: dest: of size from", "Received block a of size b from src: c dest: d",
    "BLOCK* ask 1 to delete blk_1", "BLOCKK ask x to replicate y to z", "BLOCK* ask x to replicate y to z",
    "é Receiving block a src: b dest: c", ":Transmitted block x to y", "Transmitted block x to y",
    "Starting thread to transfer block x to y é", "z" * 300,
    "VERİFICATION succeeded for x", "Verıfication succeeded for y", "é VERİFICATION ſucceeded for x",
]


def model(line):
    found = HEADER.match(line)
    fields = found.groups() if found else ("", "", "", "", "", line)
    event = next((e for e, p in PATTERNS if p.search(fields[5])), "E0")
    return (*fields, event, catalog.TEMPLATES.get(event, fields[5][:80]))


def test_lines_follow_the_rules(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "line_id bigint, value string")
    got = {r[0]: tuple(r[1:]) for r in parse.structured_lines(df).drop("ts").collect()}
    for n, line in enumerate(LINES):
        assert got[n] == model(line), line


@pytest.mark.parametrize("date, time, expected", [
    ("081109", "203518", 1226262918), ("990101", "000000", 915148800), ("690101", "000000", -31536000),
    ("680101", "000000", 3092601600), ("080230", "000000", None), ("081309", "000000", None),
    ("081109", "203560", None), ("081109", "240000", None), ("", "", None),
])
def test_timestamps(spark, date, time, expected):
    df = spark.createDataFrame([(date, time)], "d string, t string")
    assert df.select(F.unix_timestamp(C.parse_ts(F.col("d"), F.col("t")))).first()[0] == expected


@pytest.mark.parametrize("text, expected", [("E22", 22), ("e7", 7), (" 7 ", 7), ("7", 7), ("xE5y6", 5), ("-3", -3)])
def test_event_tokens(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.event_token(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize("text", ["x", "", "E", "7.5"])
def test_other_tokens_are_errors(spark, text):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(text,)], "t string").select(C.event_token(F.col("t"))).collect()


def test_byte_tokens(spark):
    assert spark.sql("SELECT cast('E9' AS binary) AS t").select(C.event_token(F.col("t"))).first()[0] == 9


@pytest.mark.parametrize("values, length, expected", [
    ([], 3, [0, 0, 0]), ([1, 2], 3, [0, 1, 2]), ([1, 2, 3], 3, [1, 2, 3]), ([1, 2, 3, 4], 3, [2, 3, 4])])
def test_pad_truncate(spark, values, length, expected):
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    assert df.select(C.pad_truncate(F.col("v"), length)).first()[0] == expected


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (-12.0,), (12345678.0,)], "g double")
    assert [r[0] for r in df.select(C.gap_text(F.col("g"))).collect()] == ["0.2", "0.4", "-12.0", "12345678.0"]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "g double")
    assert [r[0] for r in halves.select(C.round_latency(F.col("g"))).collect()] == [0, 2, 2]


def test_labels(spark):
    df = spark.createDataFrame([("Anomaly",), (" normal",), ("1",), ("2.0",)], "l string")
    assert [r[0] for r in df.select(C.label_value(F.col("l"))).collect()] == [1, 0, 1, 2]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("bad",)], "l string").select(C.label_value(F.col("l"))).collect()


def test_catalogue_of_any_length(spark, monkeypatch):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_id bigint, value string")
    parsed = parse.parse_lines(lines)
    catalogue = spark.createDataFrame(
        [(n, e, catalog.pattern(t), t) for n, (e, t) in enumerate(catalog.TEMPLATES.items())],
        "priority int, event_id string, pattern string, template string")
    columns = ["line_id", "event_id", "event_template"]
    want = rows(parse.assign_events(parsed).select(*columns))
    assert rows(parse.match_catalogue(parsed, catalogue).select(*columns)) == want
    monkeypatch.setattr(parse, "BRANCHES", 5)
    assert rows(parse.match_catalogue(parsed, catalogue).select(*columns)) == want
    empty = parse.match_catalogue(parsed, catalogue.limit(0))
    assert {r.event_id for r in empty.select("event_id").collect()} == {"E0"}


@pytest.mark.parametrize(("pattern", "runs"), [
    ("(?-i)Receiv", ["receiv"]), ("abc+d", ["abc", "d"]), ("ab?c", ["a", "c"]), ("a{2}bcd", ["bcd"]), ("x|y", []), ("", []),
    ("foo(bar|b)baz", []), ("foo(bar)?baz", ["foo", "baz"]), (r"BLOCK\* Name.+size", ["block* name", "size"]), (r"\d+ items", [" items"]),
    ("[abc]de[^]]fg", ["de", "fg"]), ("Stra\u00dfe", ["stra", "e"]), (r"\Qa.b\E", []), ("(?x)a b", []), (r"^a\[b$", ["a[b"])])
def test_literal_runs(pattern, runs):
    assert parse.literal_runs(pattern) == runs


def test_a_long_catalogue_tries_what_the_line_holds(spark, monkeypatch):
    """With and without index the same; patterns without a piece of their own are tried everywhere."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "s\u212ay", "BLOCK"]
    lines = [(n, " ".join(rng.choice(words) + rng.choice(["", "1", "22"]) for _ in range(rng.randrange(9)))) for n in range(400)] + [(999, None)]
    patterns = ["alpha1.+beta", "gam+a22", "[bd]e(ta|lta)1 om", r"\d\d", "SKY1", "^omega$", "o", "x|y", "block22", "gamma beta1"]
    catalogue = spark.createDataFrame([(n, f"X{n}", p, p) for n, p in enumerate(patterns)],
                                      "priority int, event_id string, pattern string, template string")
    parsed = spark.createDataFrame(lines, "line_id bigint, content string")
    short = parse.match_catalogue(parsed, catalogue)
    plain = parsed
    for n, pattern in reversed(list(enumerate(patterns))):
        before = F.col("event_id") if "event_id" in plain.columns else F.lit("E0")
        plain = plain.withColumn("event_id", F.when(F.col("content").rlike("(?diu)" + pattern), f"X{n}").otherwise(before))
    want = rows(plain.select("line_id", "event_id"))
    assert rows(short.select("line_id", "event_id")) == want and len({w[1] for w in want}) > 6
    monkeypatch.setattr(parse, "SHORT", 0)
    assert rows(parse.match_catalogue(parsed, catalogue).select("line_id", "event_id")) == want
    assert short.columns == ["line_id", "content", "event_id", "event_template"]


def test_any_decimal_digit_is_part_of_a_key(spark):
    text = spark.createDataFrame([("a blk_-\u0661\u0662 b blk_7 c blk_x",)], "content string")
    assert text.select(C.blocks_all(F.col("content"))).first()[0] == ["blk_-\u0661\u0662", "blk_7"]
    assert text.select(C.block_first(F.col("content"))).first()[0] == "blk_-\u0661\u0662"


def test_last_unmatched_line_gives_the_text(spark):
    lines = spark.createDataFrame([(1, "first"), (2, "second"), (3, "Reopen Block x")], "line_id bigint, value string")
    stats = {r.event_id: r for r in parse.template_stats(parse.structured_lines(lines)).collect()}
    assert stats["E0"].event_template == "second" and stats["E0"].occurrences == 2
    assert stats["E19"].event_template == "Reopen Block[*]"
