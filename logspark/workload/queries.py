"""The registered queries: one per operator, each with the SQL that must give the same rows.

Arrays are rendered as text and floats rounded, so that two engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.detectors import (
    clustering, forest, invariants, next_event, pca, report, sequence, supervised, vectors,
)
from logspark.functions import catalog
from logspark.functions import columns as C
from logspark.operators import encode, features, metrics, parse, sequences, sessions, split
from logspark.operators.skew import Limits, over_sessions
from logspark.plans import dataset
from logspark.session import shared_path, sized
from logspark.sources import datasets, logs, sinks
from logspark.streaming.logs import run_to_end, sessions_by_gap, stream_events, unexpected_pairs
from logspark.workload import views as V
from logspark.workload.sql import ERRORS, free_text_ctes, statement

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def text_of(array: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), separator)


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


# ---- sources ------------------------------------------------------------------------------------

def _written_logs(spark: SparkSession, folder: str) -> str:
    path = shared_path(spark, "lines")
    V.raw_logs(spark, folder).repartitionByRange(4, "line_id").sortWithinPartitions("line_id").select(
        "value").write.text(path)
    return path


@register("scan_log_lines", statement("SELECT value FROM raw_logs", "raw_logs"))
def scan_log_lines(spark, folder):
    return logs.scan_log_lines(spark, _written_logs(spark, folder))


@register("line_numbers", statement(
    "SELECT row_number() OVER (ORDER BY line_id) AS line_id, value FROM raw_logs", "raw_logs"))
def line_numbers(spark, folder):
    return logs.number_lines(spark, _written_logs(spark, folder))


@register("load_labels", "SELECT cast(user_id AS string) AS block_id, arg_max(cast(event_type = 'error' AS int), event_id) "
          "AS label FROM events GROUP BY user_id")
def load_labels(spark, folder):
    """A label file with many rows per id: the last one counts."""
    path = shared_path(spark, "label_rows")
    V.table(spark, folder, "events").repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select(
        F.col("user_id").alias(" BlockId "), F.when(F.col("event_type") == "error", "Anomaly").otherwise("Normal").alias("Label"),
    ).write.csv(path, header=True)
    return datasets.load_labels(spark, path)


@register("load_structured", statement("SELECT line_id, nullif(content, '') AS content, event_id FROM ev", "ev"))
def load_structured(spark, folder):
    path = shared_path(spark, "structured")
    V.events(spark, folder).select(
        F.col("line_id").alias("LineId"), F.col("content").alias("Content"), F.col("event_id").alias("EventId"),
    ).write.csv(path, header=True, escape='"', emptyValue="")
    return logs.load_structured(spark, path, order="LineId")


@register("load_structured_file_order", statement(
    "SELECT row_number() OVER (ORDER BY line_id DESC) AS line_id, event_id FROM ev", "ev"))
def load_structured_file_order(spark, folder):
    """Without a named column the rows of the file are the order, whatever their ids say."""
    path = shared_path(spark, "structured")
    V.events(spark, folder).repartitionByRange(3, F.desc("line_id")).sortWithinPartitions(F.desc("line_id")).select(
        F.col("line_id").alias("LineId"), F.col("content").alias("Content"), F.col("event_id").alias("EventId"),
    ).write.csv(path, header=True, escape='"', emptyValue="")
    return logs.load_structured(spark, path).select("line_id", "event_id")


def _segment(limit: int = Limits().max_events) -> str:
    """The segment of a row by its place ``k`` in the session."""
    return f"cast((k - 1) // {limit} AS bigint)"


#: Tuples and first keys with their place in the session.
_KTUP = "SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY line_id, pos) AS k FROM tup"
_KFIRSTS = "SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY line_id) AS k FROM firsts"


def _first_sessions(spark, folder):
    firsts = sessions.first_block_tuples(V.events(spark, folder)).withColumn("pos", F.lit(0))
    return sessions.labelled_sessions(firsts, V.block_labels(spark, folder))


@register("load_traces", statement(
    f"SELECT f.block_id, segment, x_data, cast(coalesce(label, 0) AS bigint) AS y_data FROM (SELECT block_id, {_segment()} "
    "AS segment, string_agg(event_id, ',' ORDER BY line_id) AS x_data FROM kfirsts GROUP BY ALL) f "
    "LEFT JOIN lab USING (block_id)", "firsts", "lab", kfirsts=_KFIRSTS))
def load_traces(spark, folder):
    path = shared_path(spark, "traces")
    sinks.write_sequences(_first_sessions(spark, folder).select(
        "block_id", "segment", F.transform("events", lambda e: e.event_id).alias("x_data"), F.col("label").alias("y_data")), path)
    return datasets.load_traces(spark, path).withColumn("x_data", text_of(F.col("x_data")))


def _micro(vector: Column) -> Column:
    """All numbers of a vector as text, in whole millionths, so that two engines can be compared by value."""
    return text_of(F.transform(vector, lambda v: F.round(v.cast("double") * 1000000).cast("bigint")))


@register("load_splits", statement(
    "SELECT CASE WHEN k <= n - 2 * t THEN 'train' WHEN k <= n - t THEN 'val' ELSE 'test' END AS part, id, y, x "
    "FROM (SELECT vec_id AS id, label AS y, array_to_string(list_transform(embedding, lambda v: cast(round(v::double * 1000000) AS bigint)), ',') AS x, row_number() OVER (ORDER BY vec_id) AS k, count(*) OVER () AS n, "
    "cast(floor(count(*) OVER () * 0.1) AS bigint) AS t FROM embeddings) e"))
def load_splits(spark, folder):
    path = shared_path(spark, "splits")
    datasets.write_splits(split.positional_split(V.vector_dataset(spark, folder), "id", seed=None), path)
    parts = datasets.load_splits(spark, path)
    return metrics.union_batches([df.select(F.lit(name).alias("part"), "id", "y", _micro(F.col("x")[0]).alias("x")) for name, df in parts.items()])


@register("typed_dataset", "SELECT vec_id AS id, cast(label AS bigint) AS y, "
          "array_to_string(list_transform(embedding, lambda v: cast(round(v::double * 1000000) AS bigint)), ',') AS x FROM embeddings")
def typed_dataset(spark, folder):
    return datasets.typed_dataset(V.vector_dataset(spark, folder)).select(
        "id", "y", _micro(F.col("x")[0]).alias("x"))


# ---- sinks: written and read back ---------------------------------------------------------------

@register("write_templates", statement(
    "SELECT event_id AS \"EventId\", nullif(arg_max(event_template, line_id), '') AS \"EventTemplate\", "
    "count(*) AS \"Occurrences\" FROM ev GROUP BY event_id", "ev"))
def write_templates(spark, folder):
    path = shared_path(spark, "templates")
    sinks.write_templates(parse.template_stats(V.events(spark, folder)), path)
    return spark.read.csv(path, header=True, escape='"').withColumn("Occurrences", F.col("Occurrences").cast("bigint"))


_GAPS = ("SELECT *, lag(ts_s) OVER w AS before_s, lag(line_id) OVER w AS before_line, row_number() OVER w AS k "
         "FROM tup WINDOW w AS (PARTITION BY block_id ORDER BY line_id, pos)")
_GAP = "coalesce(ts_s - before_s, 0)"


def _trace_sql(limit: int = Limits().max_events) -> str:
    return f"""SELECT s.block_id, segment, CASE WHEN label = 1 THEN 'Fail' ELSE 'Success' END AS label,
 CASE WHEN segment = 0 THEN type END AS type, features,
 CASE WHEN timed < 2 THEN '[0.0]' ELSE '[' || coalesce(gaps, '') || ']' END AS time_interval,
 CASE WHEN segment > 0 THEN NULL WHEN timed < 2 THEN 0 ELSE last_s - first_s END AS latency
FROM (SELECT block_id, {_segment(limit)} AS segment,
  '[' || string_agg(event_id, ',' ORDER BY line_id, pos) || ']' AS features,
  string_agg(cast({_GAP} AS string) || '.0', ', ' ORDER BY line_id, pos) FILTER (WHERE k > 1) AS gaps
 FROM g GROUP BY ALL) s JOIN (SELECT block_id, nullif(count(*) FILTER (WHERE event_id IN ({ERRORS})), 0) AS type,
  count(ts_s) AS timed,
  arg_min(ts_s, k) FILTER (WHERE ts_s IS NOT NULL) AS first_s,
  arg_max(ts_s, k) FILTER (WHERE ts_s IS NOT NULL) AS last_s
 FROM g GROUP BY block_id) t ON t.block_id = s.block_id LEFT JOIN lab ON lab.block_id = s.block_id"""


#: Cuts nearly every session of the test tables.
_SHORT = Limits(max_events=40)


def _trace_features(spark, folder, limits=Limits()):
    return sessions.trace_features(V.tuples(spark, folder), V.block_labels(spark, folder), limits=limits)


def _write_traces(limits: Limits) -> Query:
    def query(spark, folder):
        path = shared_path(spark, "features")
        sinks.write_traces(_trace_features(spark, folder, limits), path)
        back = spark.read.csv(path, header=True, escape='"')
        return back.withColumns({c: F.col(c).cast("bigint") for c in ("Segment", "Type", "Latency")})

    return query


for _name, _limits in (("write_traces", Limits()), ("write_traces_segmented", _SHORT)):
    register(_name, statement(
        'SELECT block_id AS "BlockId", segment AS "Segment", label AS "Label", type AS "Type", features AS "Features", '
        f'time_interval AS "TimeInterval", latency AS "Latency" FROM ({_trace_sql(_limits.max_events)}) q',
        "tup", "lab", g=_GAPS))(_write_traces(_limits))


_EVENT_IDS = [catalog.UNMATCHED_EVENT, *catalog.TEMPLATES]
_MATRIX_SQL = ", ".join(f"cast(count(*) FILTER (WHERE event_id = '{e}') AS int) AS \"{e}\"" for e in _EVENT_IDS)


def _matrix(spark, folder):
    table = V.staged_events(spark, folder)
    ids = features.observed_events(table)
    return features.occurrence_matrix(dataset.tuples_of(table), ids), ids


@register("write_matrix", statement(
    f'SELECT block_id AS "BlockId", {_MATRIX_SQL} FROM tup GROUP BY block_id', "tup"))
def write_matrix(spark, folder):
    path = shared_path(spark, "matrix")
    matrix, ids = _matrix(spark, folder)
    sinks.write_matrix(matrix, ids, path)
    back = spark.read.csv(path, header=True)
    return back.select("BlockId", *[F.col(c).cast("int").alias(c) for c in ids])


def _sequences_sql(limit: int = Limits().max_events) -> str:
    return (
        f"SELECT t.block_id, {_segment(limit)} AS segment, string_agg(cast(code AS string), ',' ORDER BY line_id, pos) AS x_data, "
        "cast(coalesce(any_value(label), 0) AS bigint) AS y_data FROM ktup t JOIN ranks USING (event_id) "
        "LEFT JOIN lab ON lab.block_id = t.block_id GROUP BY ALL")


def _sequences(spark, folder, limits=Limits()):
    table = V.staged_events(spark, folder)
    return dataset.encoded_sequences(
        dataset.tuples_of(table), V.block_labels(spark, folder), encode.event_rank(table), limits)


def _write_sequences(limits: Limits) -> Query:
    def query(spark, folder):
        path = shared_path(spark, "sequences")
        sinks.write_sequences(_sequences(spark, folder, limits), path)
        return datasets.load_traces(spark, path).withColumn("x_data", text_of(F.col("x_data")))

    return query


for _name, _limits in (("write_sequences", Limits()), ("write_sequences_segmented", _SHORT)):
    register(_name, statement(_sequences_sql(_limits.max_events), "tup", "ranks", "lab", ktup=_KTUP))(
        _write_sequences(_limits))


@register("write_labels", statement(
    'SELECT b.block_id AS "BlockId", coalesce(label, 0) AS "Label" FROM (SELECT DISTINCT block_id FROM tup) b '
    "LEFT JOIN lab ON lab.block_id = b.block_id", "tup", "lab"))
def write_labels(spark, folder):
    path = shared_path(spark, "labels")
    keys = V.tuples(spark, folder).select("block_id").distinct()
    sinks.write_labels(sessions.label_sessions(keys, V.block_labels(spark, folder)), path)
    return spark.read.csv(path, header=True).withColumn("Label", F.col("Label").cast("int"))


# ---- projections and scalar functions -----------------------------------------------------------

_PARSED = "line_id, date, time, pid, level, component, content"


@register("parse_lines", statement(f"SELECT {_PARSED} FROM parsed", "parsed"))
def parse_lines(spark, folder):
    return parse.parse_lines(V.raw_logs(spark, folder)).drop("ts")


@register("parse_free_text", statement(
    f"SELECT {_PARSED}, event_id, event_template FROM ev", "ev", **free_text_ctes()))
def parse_free_text(spark, folder):
    return parse.structured_lines(V.free_text(spark, folder)).drop("ts")


@register("parse_ts", statement("SELECT line_id, ts_s FROM parsed", "parsed"))
def parse_ts(spark, folder):
    return parse.parse_lines(V.raw_logs(spark, folder)).select("line_id", epoch(F.col("ts")).alias("ts_s"))


@register("assign_events", statement("SELECT line_id, event_id, event_template FROM ev", "ev"))
def assign_events(spark, folder):
    return V.events(spark, folder).select("line_id", "event_id", "event_template")


@register("unmatched_template", statement(
    "SELECT line_id, event_template FROM ev WHERE event_id = 'E0'", "ev"))
def unmatched_template(spark, folder):
    return V.events(spark, folder).where(F.col("event_id") == "E0").select("line_id", "event_template")


@register("blocks_all", statement(
    "SELECT line_id, block_id, cast(pos AS int) AS pos FROM tup", "tup"))
def blocks_all(spark, folder):
    return V.tuples(spark, folder).select("line_id", "block_id", "pos")


@register("block_first", statement(
    "SELECT line_id, nullif(regexp_extract(content, '(blk_-?[0-9]+)', 1), '') AS block_id FROM parsed", "parsed"))
def block_first(spark, folder):
    return parse.parse_lines(V.raw_logs(spark, folder)).select(
        "line_id", C.block_first(F.col("content")).alias("block_id"))


@register("is_error_event", statement(
    f"SELECT line_id, cast(event_id IN ({ERRORS}) AS int) AS is_error FROM ev", "ev"))
def is_error_event(spark, folder):
    return V.events(spark, folder).select("line_id", C.is_error_event(F.col("event_id")).cast("int").alias("is_error"))


_FEATURES = "'[' || string_agg(event_id, ',' ORDER BY line_id, pos) || ']'"


@register("features_string", statement(
    f"SELECT block_id, {_segment()} AS segment, {_FEATURES} AS features FROM ktup GROUP BY ALL", "tup", ktup=_KTUP))
def features_string(spark, folder):
    built = sessions.build_sessions(V.tuples(spark, folder))
    return built.select("block_id", "segment", C.features_string(F.transform("events", lambda e: e.event_id)).alias("features"))


@register("label_text", statement(
    "SELECT block_id, CASE WHEN label = 1 THEN 'Fail' ELSE 'Success' END AS label FROM lab", "lab"))
def label_text(spark, folder):
    return V.block_labels(spark, folder).select("block_id", C.label_text(F.col("label")).alias("label"))


@register("event_number", statement(
    "SELECT line_id, coalesce(try_cast(event_id[2:] AS bigint), 9999) AS event_no, 9999 AS other_no FROM ev", "ev"))
def event_number(spark, folder):
    not_numeric = F.concat(F.col("event_id"), F.lit("x"))
    return V.events(spark, folder).select(
        "line_id", C.event_number(F.col("event_id")).alias("event_no"),
        C.event_number(not_numeric).cast("int").alias("other_no"))


@register("event_token", statement(
    "SELECT line_id, CASE line_id % 4 WHEN 3 THEN line_id ELSE cast(event_id[2:] AS bigint) END AS token "
    "FROM ev", "ev"))
def event_token(spark, folder):
    spelt = (
        F.when(F.col("line_id") % 4 == 0, F.col("event_id"))
        .when(F.col("line_id") % 4 == 1, F.concat(F.lit(" "), F.lower("event_id"), F.lit("\t")))
        .when(F.col("line_id") % 4 == 2, F.concat(F.lit("  "), F.substring("event_id", 2, 9), F.lit(" ")))
        .otherwise(F.col("line_id").cast("string")))
    return V.events(spark, folder).select("line_id", C.event_token(spelt).alias("token"))


def _turn_tokens(spark, folder, length: int):
    """The last ``length`` tokens of each conversation, zeros in front."""
    return sequences.padded_tokens(V.turn_traces(spark, folder), "session", ["pos"], "token", length)


@register("shift_pad_id", statement(
    f"SELECT session, {_segment()} AS segment, string_agg(cast(token + 1 AS string), ',' ORDER BY pos) AS tokens FROM "
    "(SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) AS k FROM turns) t GROUP BY ALL", "turns"))
def shift_pad_id(spark, folder):
    turns = V.turn_traces(spark, folder).select(
        F.col("session").alias("block_id"), F.col("pos").alias("line_id"), F.lit(0).alias("pos"),
        F.col("token").alias("event_id"), F.lit(None).cast("timestamp").alias("ts"))
    tokens = F.transform("events", lambda e: e.event_id)
    return sessions.build_sessions(turns).select(
        F.col("block_id").alias("session"), "segment", text_of(C.shift_tokens(tokens)).alias("tokens"))


@register("pad_truncate", statement(
    "SELECT session, repeat('0,', cast(greatest(4 - n, 0) AS bigint)) || tokens AS tokens FROM (SELECT session, "
    "any_value(n) AS n, string_agg(cast(token AS string), ',' ORDER BY pos) AS tokens FROM (SELECT *, "
    "row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS k, count(*) OVER (PARTITION BY session) AS n "
    "FROM turns) t WHERE k <= 4 GROUP BY session) p", "turns"))
def pad_truncate(spark, folder):
    return _turn_tokens(spark, folder, 4).select("session", text_of(F.col("tokens")).alias("tokens"))


@register("binarise_label", "SELECT vec_id AS id, cast(label <> 0 AS int) AS y FROM embeddings")
def binarise_label(spark, folder):
    return V.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), C.binarise_label(F.col("label")).alias("y"))


@register("encode_sequence", statement(_sequences_sql(), "tup", "ranks", "lab", ktup=_KTUP))
def encode_sequence(spark, folder):
    return _sequences(spark, folder).withColumn("x_data", text_of(F.col("x_data")))


@register("sigmoid_threshold",
          "SELECT event_id AS id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS prob, "
          "cast(1 / (1 + exp(-(value - 50) / 10)) > 0.5 AS int) AS pred FROM events")
def sigmoid_threshold(spark, folder):
    prob = C.sigmoid((F.col("value") - 50) / 10)
    return V.table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.round(prob, 6).alias("prob"), C.above(prob).alias("pred"))


@register("valid_ts", statement(
    f"SELECT block_id, {_segment()} AS segment, string_agg(cast(ts_s AS string), ',' ORDER BY line_id, pos) AS times FROM ktup "
    "WHERE ts_s IS NOT NULL GROUP BY ALL", "tup", ktup=_KTUP))
def valid_ts(spark, folder):
    timed = F.filter("events", lambda e: e.ts.isNotNull())
    built = sessions.build_sessions(V.tuples(spark, folder))
    return built.where(F.size(timed) > 0).select(
        "block_id", "segment", text_of(F.transform(timed, lambda e: epoch(e.ts))).alias("times"))


@register("round_gap", statement(
    # Half to even, in tenths, worked out in whole milliseconds.
    "SELECT line_id, ms, cast(ms // 100 + CASE WHEN ms % 100 > 50 OR (ms % 100 = 50 AND ms // 100 % 2 = 1) THEN 1 ELSE 0 END "
    "AS double) / 10 AS rounded FROM (SELECT event_id AS line_id, date_diff('millisecond', lag(ts) OVER w, ts) AS ms FROM events "
    "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) e WHERE ms IS NOT NULL"))
def round_gap(spark, folder):
    rows = V.table(spark, folder, "events").select(
        F.col("event_id").alias("line_id"), "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))

    def gaps(df: DataFrame, window) -> DataFrame:
        return df.withColumn("ms", F.col("at") - F.lag("at").over(window))

    found = over_sessions(rows, "user_id", ["at", "line_id"], 1, gaps).where("ms is not null")
    return found.select("line_id", "ms", C.round_gap(F.col("ms") / 1000).alias("rounded"))


@register("safe_ratio", statement(
    "SELECT session, round(CASE WHEN \"error\" > 0 THEN click / \"error\" ELSE 0.0 END, 6) AS ratio FROM daily", "daily"))
def safe_ratio(spark, folder):
    return V.daily_counts(spark, folder).select(
        "session", F.round(C.safe_ratio(F.col("click"), F.col("error")), 6).alias("ratio"))


# ---- joins --------------------------------------------------------------------------------------

@register("label_sessions", statement(
    "SELECT b.block_id, coalesce(label, 0) AS label FROM (SELECT DISTINCT block_id FROM tup) b "
    "LEFT JOIN lab ON lab.block_id = b.block_id", "tup", "lab"))
def label_sessions(spark, folder):
    keys = V.tuples(spark, folder).select("block_id").distinct()
    return sessions.label_sessions(keys, V.block_labels(spark, folder))


@register("event_codes_join", statement(
    "SELECT block_id, line_id, cast(pos AS int) AS pos, code FROM tup JOIN ranks USING (event_id)", "tup", "ranks"))
def event_codes_join(spark, folder):
    table = V.staged_events(spark, folder)
    coded = encode.join_codes(dataset.tuples_of(table), encode.event_rank(table))
    return coded.select("block_id", "line_id", "pos", "code")


@register("encoder_transform", statement(
    "SELECT line_id, code FROM firsts JOIN (SELECT event_id, cast(row_number() OVER (ORDER BY event_id) - 1 AS bigint)"
    " AS code FROM (SELECT DISTINCT event_id FROM firsts) d) c USING (event_id)", "firsts"))
def encoder_transform(spark, folder):
    firsts = sessions.first_block_tuples(V.events(spark, folder))
    return encode.encoder_transform(firsts, encode.lexical_rank(firsts)).select("line_id", "code")


@register("match_catalogue", statement("SELECT line_id, event_id, event_template FROM ev", "ev"))
def match_catalogue(spark, folder):
    return _matched(spark, folder, [(n, e, catalog.pattern(t), t) for n, (e, t) in enumerate(catalog.TEMPLATES.items())])


@register("match_catalogue_shared_id", statement(
    "SELECT line_id, CASE WHEN contains(value, 'Receiv') OR contains(value, 'size') THEN 'S1' ELSE 'E0' END AS event_id, CASE "
    "WHEN contains(value, 'Receiv') THEN 'T-receive' WHEN contains(value, 'size') THEN 'T-size' ELSE value[:80] END AS "
    "event_template FROM (SELECT line_id, content AS value FROM parsed) p", "parsed"))
def match_catalogue_shared_id(spark, folder):
    """Two patterns of one event: each line shows the text of its own pattern."""
    rows = [(1, "S1", "(?-i)Receiv", "T-receive"), (2, "S1", "(?-i)size", "T-size")]
    return _matched(spark, folder, rows)


@register("match_catalogue_long", statement(
    "SELECT line_id, CASE WHEN n IS NULL THEN 'E0' ELSE 'L' || n END AS event_id, CASE WHEN n IS NULL THEN value[:80] ELSE "
    "'user ' || n END AS event_template FROM (SELECT line_id, content AS value, "
    "(SELECT min(i) FROM range(0, 600) r(i) WHERE contains(content, cast(7000000000 + i * 7919 AS string))) AS n FROM parsed) p",
    "parsed"))
def match_catalogue_long(spark, folder):
    """Six hundred patterns, one per session key."""
    rows = [(n, f"L{n}", str(7000000000 + n * 7919), f"user {n}") for n in range(600)]
    return _matched(spark, folder, rows)


def _matched(spark, folder, rows):
    catalogue = spark.createDataFrame(rows, "priority int, event_id string, pattern string, template string")
    parsed = parse.parse_lines(V.raw_logs(spark, folder))
    return parse.match_catalogue(parsed, catalogue).select("line_id", "event_id", "event_template")


@register("template_id_filter", statement("SELECT line_id, block_id FROM firsts", "firsts"))
def template_id_filter(spark, folder):
    return sessions.first_block_tuples(V.events(spark, folder)).select("line_id", "block_id")


# ---- aggregations -------------------------------------------------------------------------------

@register("template_stats", statement(
    "SELECT event_id, arg_max(event_template, line_id) AS event_template, count(*) AS occurrences "
    "FROM ev GROUP BY event_id", "ev"))
def template_stats(spark, folder):
    return parse.template_stats(V.events(spark, folder))


@register("parse_summary", statement(
    "SELECT 'lines' AS counter, count(*) AS value FROM ev UNION ALL "
    "SELECT 'unmatched', count(*) FILTER (WHERE event_id = 'E0') FROM ev UNION ALL "
    "SELECT 'sessions', count(DISTINCT block_id) FROM tup UNION ALL "
    "SELECT 'labels', count(*) FROM lab UNION ALL "
    "SELECT 'anomalies', count(*) FILTER (WHERE label = 1) FROM lab", "tup", "lab"))
def parse_summary(spark, folder):
    table = V.staged_events(spark, folder)
    return parse.parse_summary(table, dataset.tuples_of(table), V.block_labels(spark, folder))


_BUILT = "string_agg(line_id || ':' || pos || ':' || event_id, ' ' ORDER BY line_id, pos) AS events"


def _events_text(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda e: F.concat_ws(
        ":", e.line_id.cast("string"), e.pos.cast("string"), e.event_id)), " ")


def _build_sessions(limits: Limits) -> Query:
    return lambda spark, folder: sessions.build_sessions(V.tuples(spark, folder), limits).select(
        "block_id", "segment", _events_text(F.col("events")).alias("events"))


for _name, _limits in (("build_sessions", Limits()), ("build_sessions_segmented", _SHORT)):
    register(_name, statement(
        f"SELECT block_id, {_segment(_limits.max_events)} AS segment, {_BUILT} FROM ktup GROUP BY ALL", "tup", ktup=_KTUP))(
        _build_sessions(_limits))


@register("sequences_first_block", statement(
    f"SELECT block_id, {_segment()} AS segment, string_agg(event_id, ',' ORDER BY line_id) AS sequence FROM kfirsts GROUP BY ALL",
    "firsts", kfirsts=_KFIRSTS))
def sequences_first_block(spark, folder):
    firsts = sessions.first_block_tuples(V.events(spark, folder)).withColumn("pos", F.lit(0))
    return sessions.build_sessions(firsts).select(
        "block_id", "segment", text_of(F.transform("events", lambda e: e.event_id)).alias("sequence"))


@register("error_count", statement(
    f"SELECT block_id, nullif(count(*) FILTER (WHERE event_id IN ({ERRORS})), 0) AS type FROM tup GROUP BY block_id",
    "tup"))
def error_count(spark, folder):
    return features.error_counts(V.tuples(spark, folder))


@register("latency", statement(
    "SELECT block_id, CASE WHEN count(ts_s) < 2 THEN 0 ELSE arg_max(ts_s, line_id * 1000 + pos) FILTER (WHERE ts_s IS NOT "
    "NULL) - arg_min(ts_s, line_id * 1000 + pos) FILTER (WHERE ts_s IS NOT NULL) END AS latency FROM tup "
    "GROUP BY block_id", "tup"))
def latency(spark, folder):
    return features.latencies(V.tuples(spark, folder))


@register("trace_features", statement(_trace_sql(), "tup", "lab", g=_GAPS))
def trace_features(spark, folder):
    return _trace_features(spark, folder)


@register("trace_features_segmented", statement(_trace_sql(_SHORT.max_events), "tup", "lab", g=_GAPS))
def trace_features_segmented(spark, folder):
    return _trace_features(spark, folder, _SHORT)


@register("occurrence_matrix", statement(
    f"SELECT block_id, {_MATRIX_SQL} FROM tup GROUP BY block_id", "tup"))
def occurrence_matrix(spark, folder):
    return _matrix(spark, folder)[0]


@register("event_counts_long", statement(
    "SELECT block_id, event_id, count(*) AS n FROM tup GROUP BY ALL", "tup"))
def event_counts_long(spark, folder):
    return features.event_counts(V.tuples(spark, folder))


@register("distinct_events", statement("SELECT DISTINCT event_id FROM ev", "ev"))
def distinct_events(spark, folder):
    return parse.distinct_events(V.events(spark, folder))


@register("dedupe_labels", "SELECT user_id AS block_id, arg_max(cast(event_type = 'error' AS int), event_id) AS label "
          "FROM events GROUP BY user_id")
def dedupe_labels(spark, folder):
    rows = V.table(spark, folder, "events").select(
        F.col("user_id").alias("block_id"), (F.col("event_type") == "error").cast("int").alias("label"), "event_id")
    return datasets.dedupe_labels(rows, "event_id")


@register("confusion_matrix", statement("SELECT * FROM confusion", "confusion"))
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(V.scores(spark, folder))


_PRF_SQL = """SELECT tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(p, 6) AS "precision", round(r, 6) AS recall,
 round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
FROM (SELECT *, (tp + tn) / greatest(tp + tn + fp + fn, 1) AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM confusion) m"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@register("prf_metrics", statement(_PRF_SQL, "confusion"))
def prf_metrics(spark, folder):
    return _rounded(metrics.prf_metrics(V.scores(spark, folder)), "accuracy", "precision", "recall", "f1")


@register("batch_weighted_accuracy", statement(
    "SELECT round(sum(acc * n) / greatest(sum(n), 1), 6) AS accuracy FROM (SELECT id // 128, count(*) AS n, "
    "avg(CASE WHEN (prob > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS acc FROM scores GROUP BY 1) b", "scores"))
def batch_weighted_accuracy(spark, folder):
    batches = V.scores(spark, folder).withColumn("batch", F.floor(F.col("id") / 128))
    return _rounded(metrics.batch_weighted_accuracy(batches), "accuracy")


@register("num_tokens", statement("SELECT max(token) + 1 + 1 AS num_tokens FROM turns", "turns"))
def num_tokens(spark, folder):
    # Every turn counts, not only those that a tail of fixed length keeps.
    shifted = V.turn_traces(spark, folder).select(C.shift_tokens(F.array("token")).alias("tokens"))
    return encode.num_tokens(shifted)


_HALVES = ("SELECT *, CASE WHEN k <= n // 2 THEN 'train' ELSE 'test' END AS split FROM (SELECT *, "
           "row_number() OVER (PARTITION BY y ORDER BY session) AS k, count(*) OVER (PARTITION BY y) AS n FROM daily) d")


@register("class_summary", statement(
    "SELECT coalesce(split, 'total') AS split, count(*) AS instances, count(*) FILTER (WHERE y = 1) AS anomaly, "
    "count(*) FILTER (WHERE y <> 1) AS normal FROM halves GROUP BY ROLLUP (split)", "daily", halves=_HALVES))
def class_summary(spark, folder):
    halves = split.stratified_split(V.daily_counts(spark, folder), "session", "y", seed=None)
    return metrics.class_summary(halves, "y")


@register("accuracy_from_totals", statement(
    "SELECT normal, abnormal, fp, fn, normal - fp AS tn, abnormal - fn AS tp, "
    "round((normal - fp + abnormal - fn) / (normal + abnormal), 6) AS accuracy FROM "
    "(SELECT tn + fp AS normal, fn + tp AS abnormal, fp, fn FROM confusion) t", "confusion"))
def accuracy_from_totals(spark, folder):
    totals = metrics.confusion_matrix(V.scores(spark, folder)).select(
        (F.col("tn") + F.col("fp")).alias("normal"), (F.col("fn") + F.col("tp")).alias("abnormal"), "fp", "fn")
    return _rounded(metrics.accuracy_from_totals(totals), "accuracy")


@register("all_events_flat", statement(
    "SELECT event_id, cast(row_number() OVER (ORDER BY event_id) - 1 AS bigint) AS code FROM "
    "(SELECT DISTINCT event_id FROM firsts) d", "firsts"))
def all_events_flat(spark, folder):
    return encode.lexical_rank(sessions.first_block_tuples(V.events(spark, folder)))


# ---- windows ------------------------------------------------------------------------------------

@register("event_gaps", statement(
    f"SELECT block_id, line_id, cast(pos AS int) AS pos, cast({_GAP} AS double) AS gap FROM g WHERE k > 1",
    "tup", g=_GAPS))
def event_gaps(spark, folder):
    return sessions.event_gaps(V.tuples(spark, folder)).select("block_id", "line_id", "pos", "gap")


@register("event_gaps_segmented", statement(
    f"SELECT block_id, line_id, cast(pos AS int) AS pos, cast({_GAP} AS double) AS gap FROM g WHERE k > 1",
    "tup", g=_GAPS))
def event_gaps_segmented(spark, folder):
    return sessions.event_gaps(V.tuples(spark, folder), _SHORT).select("block_id", "line_id", "pos", "gap")


@register("time_interval", statement(
    f"SELECT block_id, segment, time_interval FROM ({_trace_sql()}) q", "tup", "lab", g=_GAPS))
def time_interval(spark, folder):
    return _trace_features(spark, folder).select("block_id", "segment", "time_interval")


@register("event_rank", statement("SELECT event_id, code FROM ranks", "ranks"))
def event_rank(spark, folder):
    return encode.event_rank(V.events(spark, folder))


@register("lexical_rank", statement(
    "SELECT event_id, cast(row_number() OVER (ORDER BY event_id) - 1 AS bigint) AS code FROM "
    "(SELECT DISTINCT event AS event_id FROM turns) d", "turns"))
def lexical_rank(spark, folder):
    return encode.lexical_rank(V.turn_traces(spark, folder), "event")


@register("cumulative_tp_fp", statement("SELECT id, rank, tp, fp FROM curve", "curve"))
def cumulative_tp_fp(spark, folder):
    return metrics.cumulative_tp_fp(V.scores(spark, folder)).select("id", "rank", "tp", "fp")


@register("last_n_events", statement(
    "SELECT session, line_id, event, k AS from_end FROM (SELECT *, row_number() OVER (PARTITION BY session "
    "ORDER BY line_id DESC) AS k FROM traces) t WHERE k <= 64", "traces"))
def last_n_events(spark, folder):
    return sequences.last_n_events(V.event_traces(spark, folder), "session", ["line_id"], 64).select(
        "session", "line_id", "event", F.col("from_end").cast("bigint").alias("from_end"))


_LAGS = ", ".join(f"coalesce(lag(token, {n}) OVER w, 0) AS lag_{n}" for n in (1, 2, 4, 8))


@register("dilated_lags", statement(
    f"SELECT session, line_id, token, {_LAGS} FROM traces WINDOW w AS (PARTITION BY session ORDER BY line_id)", "traces"))
def dilated_lags(spark, folder):
    return sequences.dilated_lags(V.event_traces(spark, folder), "session", ["line_id"], "token").select(
        "session", "line_id", "token", *[f"lag_{n}" for n in (1, 2, 4, 8)])


_PAIRS = ("SELECT session, line_id, b2 || ' ' || b1 AS context, event AS next FROM (SELECT *, lag(event, 1) OVER w AS b1, "
          "lag(event, 2) OVER w AS b2 FROM traces WINDOW w AS (PARTITION BY session ORDER BY line_id)) p "
          "WHERE b2 IS NOT NULL")


@register("next_event_pairs", statement("SELECT * FROM pairs", "traces", pairs=_PAIRS))
def next_event_pairs(spark, folder):
    return sequences.next_event_pairs(V.event_traces(spark, folder), "session", ["line_id"], "event", 2).select(
        "session", "line_id", "context", "next")


@register("next_event_pairs_segmented", statement("SELECT * FROM pairs", "traces", pairs=_PAIRS))
def next_event_pairs_segmented(spark, folder):
    return sequences.next_event_pairs(
        V.event_traces(spark, folder), "session", ["line_id"], "event", 2, Limits(max_events=30)).select(
        "session", "line_id", "context", "next")


# ---- sort, limit, sample, split, set operations -------------------------------------------------

@register("sort_sessions", statement(
    "SELECT block_id, count(*) AS n FROM tup GROUP BY block_id ORDER BY block_id", "tup"))
def sort_sessions(spark, folder):
    return V.tuples(spark, folder).groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).orderBy("block_id")


@register("sort_events", statement("SELECT event_id, code FROM ranks ORDER BY code", "ranks"))
def sort_events(spark, folder):
    return features.ordered_events(V.events(spark, folder))


@register("rank_by_score", statement("SELECT id, prob, y FROM scores ORDER BY prob DESC, id", "scores"))
def rank_by_score(spark, folder):
    return metrics.rank_by_score(V.scores(spark, folder).select("id", "prob", "y"))


@register("preview", statement("SELECT line_id, event_id, content FROM ev ORDER BY line_id LIMIT 5", "ev"))
def preview(spark, folder):
    return V.events(spark, folder).select("line_id", "event_id", "content").orderBy("line_id").limit(5)


@register("seeded_shuffle", statement("SELECT * FROM daily", "daily"))
def seeded_shuffle(spark, folder):
    return split.seeded_shuffle(V.daily_counts(spark, folder), "session", 42)


@register("cap_traces", statement("SELECT * FROM daily ORDER BY session LIMIT 1000", "daily"))
def cap_traces(spark, folder):
    return split.cap_traces(V.daily_counts(spark, folder), "session", 1000, seed=None)


@register("positional_split", statement(
    "SELECT session, CASE WHEN k <= n - 2 * t THEN 'train' WHEN k <= n - t THEN 'val' ELSE 'test' END AS split FROM "
    "(SELECT session, row_number() OVER (ORDER BY session) AS k, count(*) OVER () AS n, "
    "cast(floor(count(*) OVER () * 0.1) AS bigint) AS t FROM daily) d", "daily"))
def positional_split(spark, folder):
    return split.positional_split(V.daily_counts(spark, folder).select("session"), "session", seed=None)


@register("stratified_split", statement("SELECT session, y, split FROM halves", "daily", halves=_HALVES))
def stratified_split(spark, folder):
    return split.stratified_split(V.daily_counts(spark, folder).select("session", "y"), "session", "y", seed=None)


@register("best_epoch", statement(
    "SELECT epoch, round(accuracy, 6) AS accuracy FROM (SELECT strftime(day, '%Y-%m-%d') AS epoch, "
    "avg(CASE WHEN (prob > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM scores GROUP BY 1) e "
    "ORDER BY e.accuracy DESC, epoch LIMIT 1", "scores"))
def best_epoch(spark, folder):
    days = V.scores(spark, folder).withColumn("epoch", F.date_format("day", "yyyy-MM-dd"))
    results = metrics.prf_metrics(days, by=["epoch"]).select("epoch", "accuracy")
    return _rounded(metrics.best_epoch(results), "accuracy")


@register("union_batches", statement("SELECT id, prob, y FROM scores", "scores"))
def union_batches(spark, folder):
    scores = V.scores(spark, folder).select("id", "prob", "y")
    return metrics.union_batches([scores.where(F.col("y") == label) for label in (0, 1)])


_CURVE = ("SELECT rank, round(r, 6) AS recall, round(p, 6) AS \"precision\" FROM curve UNION ALL SELECT 0, 0.0, 1.0 "
          "UNION ALL SELECT max(rank) + 1, 1.0, round(arg_max(p, rank), 6) FROM curve")


@register("pr_endpoints", statement(
    f"SELECT * FROM ({_CURVE}) c WHERE rank IN (0, (SELECT count(*) + 1 FROM scores))", "curve"))
def pr_endpoints(spark, folder):
    return _rounded(metrics.pr_end_points(metrics.pr_points(V.scores(spark, folder))), "recall", "precision")


# ---- curves -------------------------------------------------------------------------------------

@register("pr_points", statement(
    "SELECT id, rank, round(r, 6) AS recall, round(p, 6) AS \"precision\" FROM curve", "curve"))
def pr_points(spark, folder):
    return _rounded(metrics.pr_points(V.scores(spark, folder)).select("id", "rank", "recall", "precision"),
                    "recall", "precision")


_AUC = ("SELECT round(sum((r - pr) * (p + pp) / 2), 6) AS pr_auc FROM (SELECT *, lag(r, 1, 0.0) OVER (ORDER BY rank) AS pr, "
        "lag(p, 1, 1.0) OVER (ORDER BY rank) AS pp FROM curve) a")
_AP = ("SELECT round(sum((r - pr) * p), 6) AS average_precision FROM (SELECT *, lag(r, 1, 0.0) OVER (ORDER BY rank) AS pr "
       "FROM curve) a WHERE r > pr")


@register("pr_auc", statement(_AUC, "curve"))
def pr_auc(spark, folder):
    return _rounded(metrics.pr_summary(V.scores(spark, folder)).select("pr_auc"), "pr_auc")


@register("average_precision", statement(_AP, "curve"))
def average_precision(spark, folder):
    return _rounded(metrics.pr_summary(V.scores(spark, folder)).select("average_precision"), "average_precision")


@register("pr_curve", statement(_CURVE, "curve"))
def pr_curve(spark, folder):
    return _rounded(metrics.pr_curve(V.scores(spark, folder)), "recall", "precision")


@register("pr_summary", statement(
    f"SELECT count(*) AS n, count(*) FILTER (WHERE y = 1) AS positives, ({_AUC}) AS pr_auc, "
    f"({_AP}) AS average_precision FROM scores", "curve"))
def pr_summary(spark, folder):
    return _rounded(metrics.pr_summary(V.scores(spark, folder)), "pr_auc", "average_precision")


@register("write_pr_curve", statement(_CURVE, "curve"))
def write_pr_curve(spark, folder):
    path = shared_path(spark, "curve")
    scores = V.scores(spark, folder)
    sinks.write_pr_curve(metrics.pr_curve(scores), metrics.pr_summary(scores), path)
    return _rounded(spark.read.parquet(f"{path}/points"), "recall", "precision")


# ---- detectors ----------------------------------------------------------------------------------

_DAILY = V.DAILY_EVENTS
_PAIRED = V.PAIRED_EVENTS


def _halves(spark, folder):
    return split.stratified_split(V.daily_counts(spark, folder), "session", "y", seed=None)


@register("count_vectors", statement(
    'SELECT split, session, click, "error", purchase, signup, "view" FROM halves', "daily", halves=_HALVES))
def count_vectors(spark, folder):
    rows = V.table(spark, folder, "events").select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session"),
        "event_type")
    halves = _halves(spark, folder).select("session", "split")
    parts = [rows.join(halves.where(F.col("split") == name).select("session"), "session", "left_semi")
             for name in ("train", "test")]
    train, test = vectors.count_vectors(*parts, _DAILY, "session", "event_type")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def _flags(detector, rows, *extra):
    return detector.transform(rows).select("session", "y", *extra, "pred")


# Normal sessions of this view lie on one line, (1, 1, 2): their error is 0, that of the others what is left across it.
@register("pca_detector", statement(
    "SELECT session, y, y AS pred, round(opened * opened + closed * closed + checked * checked - "
    "(opened + closed + 2 * checked) * (opened + closed + 2 * checked) / 6.0, 6) AS score FROM paired", "paired"))
def pca_detector(spark, folder):
    rows = V.paired_counts(spark, folder)
    model = pca.fit_pca(rows.where("y = 0"), _PAIRED, components=1, weighting="none", threshold=0.1)
    return _flags(model, rows, F.round("score", 6).alias("score"))


# Error and threshold from moments alone: one component of two counts, in closed form.
_MOMENTS = ('SELECT *, sqrt((a - c) * (a - c) + 4 * b * b) AS d FROM (SELECT count(*) AS n, avg(click) AS mx, avg("view") AS my, '
            'var_pop(click) AS a, covar_pop(click, "view") AS b, var_pop("view") AS c FROM daily) m')


@register("pca_moments", statement(
    # What is left of a row along the direction of least variance, (b, w).
    "SELECT session, round((b * (x - mx) + w * (v - my)) * (b * (x - mx) + w * (v - my)) / (b * b + w * w), 6) AS score FROM "
    "(SELECT session, click AS x, \"view\" AS v FROM daily) r, (SELECT *, (c - a - d) / 2 AS w FROM moments) m",
    "daily", moments=_MOMENTS))
def pca_moments(spark, folder):
    rows = V.daily_counts(spark, folder)
    model = pca.fit_pca(rows, ["click", "view"], components=1, weighting="none")
    return model.transform(rows).select("session", F.round("score", 6).alias("score"))


_GIVEN = [("click", "view", 1, -1), ("signup", "purchase", 2, -1), ("error", "view", 1, -2)]
_BROKEN = [f'({a} * "{i}" + {b} * "{j}" <> 0)' for i, j, a, b in _GIVEN]


@register("invariant_violations", statement(
    "SELECT session, y, score, cast(score > 0 AS int) AS pred FROM (SELECT session, y, "
    + " + ".join(f"cast({b} AS int)" for b in _BROKEN) + " AS score FROM daily) v", "daily"))
def invariant_violations(spark, folder):
    return invariants.flag_violations(V.daily_counts(spark, folder), _GIVEN).select("session", "y", "score", "pred")


@register("invariant_support", statement(" UNION ALL ".join(
    f"SELECT '{i}' AS first_event, '{j}' AS second_event, round(avg(CASE WHEN {b} THEN 0.0 ELSE 1.0 END), 6) AS support, "
    f'round(avg(CASE WHEN {b} THEN 0.0 ELSE 1.0 END) FILTER (WHERE "{i}" <> 0 OR "{j}" <> 0), 6) AS support_nonzero '
    "FROM daily" for (i, j, _, _), b in zip(_GIVEN, _BROKEN)), "daily"))
def invariant_support(spark, folder):
    rows = vectors.distinct_vectors(V.daily_counts(spark, folder), _DAILY)
    share, nonzero = invariants.supports(rows, _DAILY, _GIVEN)
    return spark.createDataFrame(
        [(p[0], p[1], round(float(s), 6), round(float(t), 6)) for p, s, t in zip(_GIVEN, share, nonzero)],
        "first_event string, second_event string, support double, support_nonzero double")


_ROLE_PAIRS = [(i, j) for n, i in enumerate(V.ROLES) for j in V.ROLES[n + 1:]]
_PAIR_SUMS = " UNION ALL ".join(
    f"SELECT '{i}' AS first_event, '{j}' AS second_event, sum(\"{i}\" * \"{i}\")::double AS a, "
    f"sum(\"{i}\" * \"{j}\")::double AS b, sum(\"{j}\" * \"{j}\")::double AS c FROM roles" for i, j in _ROLE_PAIRS)
_PAIR_KEPT = " UNION ALL ".join(
    f"SELECT f.first_event, f.second_event, any_value(f.factor_1) AS factor_1, any_value(f.factor_2) AS factor_2, "
    f"round(avg(CASE WHEN factor_1 * \"{i}\" + factor_2 * \"{j}\" = 0 THEN 1.0 ELSE 0.0 END), 6) AS support "
    f"FROM roles, factors f WHERE f.first_event = '{i}' AND f.second_event = '{j}' GROUP BY ALL" for i, j in _ROLE_PAIRS)


@register("invariant_candidates", statement(
    _PAIR_KEPT, "roles", sums=_PAIR_SUMS,
    # Smallest eigenvector (b, l - a) of [[a, b], [b, c]], scaled to a smallest entry of 1.
    factors="SELECT first_event, second_event, cast(round(b / m) AS bigint) AS factor_1, cast(round((l - a) / m) AS bigint) "
            "AS factor_2 FROM (SELECT *, least(abs(b), abs(l - a)) AS m FROM (SELECT *, (a + c) / 2 - "
            "sqrt((a - c) * (a - c) / 4 + b * b) AS l FROM sums) e) s WHERE m > 0"))
def invariant_candidates(spark, folder):
    rows = vectors.distinct_vectors(V.role_counts(spark, folder), V.ROLES)
    pairs = invariants.candidate_pairs(vectors.gram(rows, V.ROLES)[1:, 1:], V.ROLES)
    share, _ = invariants.supports(rows, V.ROLES, pairs)
    return spark.createDataFrame(
        [(*p, round(float(s), 6)) for p, s in zip(pairs, share)],
        "first_event string, second_event string, factor_1 bigint, factor_2 bigint, support double")


@register("invariant_miner", statement(
    "SELECT session, y, y AS pred, cast(opened <> closed AS int) AS score FROM paired", "paired"))
def invariant_miner(spark, folder):
    rows = V.paired_counts(spark, folder)
    return _flags(invariants.fit_invariants(rows, _PAIRED, keep=0.8), rows, F.col("score").cast("int").alias("score"))


@register("log_clustering", statement(
    "SELECT session, y, y AS pred, round(1 - (opened + closed + 2 * checked) / sqrt(6.0 * (opened * opened + closed * closed + "
    "checked * checked)), 6) + 0.0 AS score FROM paired", "paired"))
def log_clustering(spark, folder):
    rows = V.paired_counts(spark, folder)
    model = clustering.fit_clusters(rows.where(F.col("y") == 0), _PAIRED, max_distance=0.0, weighting="none")
    return _flags(model, rows, (F.abs(F.round("score", 6)) + 0.0).alias("score"))


@register("log_clustering_online", statement(
    "SELECT round(closed / opened, 6) AS ratio, count(*) AS sessions FROM paired GROUP BY 1", "paired"))
def log_clustering_online(spark, folder):
    """Fitted on the sessions that balance, then told that the others are normal too: a cluster per direction."""
    rows = V.paired_counts(spark, folder)
    model = clustering.fit_clusters(rows.where(F.col("y") == 0), _PAIRED, max_distance=0.0, weighting="none")
    return model.updated(rows.where(F.col("y") != 0)).summaries(rows).select(
        F.round(F.col("unit")[1] / F.col("unit")[0], 6).alias("ratio"), "sessions")


@register("isolation_forest")
def isolation_forest(spark, folder):
    rows = V.daily_counts(spark, folder)
    return _flags(forest.fit_forest(rows, _DAILY, "session", contamination=0.08), rows, "score")


def _supervised(kind: str) -> Query:
    def query(spark, folder):
        rows = _halves(spark, folder)
        train = rows.where(F.col("split") == "train")
        return _flags(supervised.fit_supervised(train, _DAILY, "y", kind), rows, "split")

    return query


# The label is a rule on one count, so a classifier fitted on one half must find it in the other.
for _kind in supervised.KINDS:
    register(_kind, statement("SELECT session, y, split, y AS pred FROM halves", "daily", halves=_HALVES))(
        _supervised(_kind))


_USERS = "SELECT t.*, coalesce(toxic, 0) AS y FROM traces t LEFT JOIN labels ON labels.doc_id = t.session"


@register("next_event_topg", statement(
    "SELECT s.session, cast(coalesce(pairs, 0) AS bigint) AS pairs, cast(coalesce(unexpected, 0) AS bigint) AS unexpected, "
    "cast(coalesce(unexpected, 0) > 0 AS int) AS pred FROM (SELECT DISTINCT session FROM traces) s LEFT JOIN ("
    "SELECT session, count(*) AS pairs, count(*) FILTER (WHERE k.next IS NULL) AS unexpected FROM pairs p "
    "LEFT JOIN tops k USING (context, next) GROUP BY session) f ON f.session = s.session",
    "traces", users=_USERS, pairs=_PAIRS,
    tops="SELECT context, next FROM (SELECT context, next, row_number() OVER (PARTITION BY context ORDER BY count(*) DESC, "
         "next) AS place FROM pairs WHERE session IN (SELECT session FROM users WHERE y = 0) GROUP BY context, next) t "
         "WHERE place <= 3"))
def next_event_topg(spark, folder):
    events = V.event_traces(spark, folder)
    toxic = V.table(spark, folder, "labels").select(F.col("doc_id").alias("session"), "toxic")
    normal = events.join(toxic.where(F.col("toxic") != 0), "session", "left_anti")
    return next_event.fit_next_events(normal, "session", ["line_id"], "event", history=2, g=3).transform(events)


def _days(spark, folder):
    """Events of each user's days."""
    return V.event_traces(spark, folder).withColumn(
        "session", F.concat_ws("|", F.col("session").cast("string"), F.date_format("ts", "yyyy-MM-dd")))


def _labelled_traces(spark, folder, length=64):
    """Daily traces, labelled by how they end: 1 after an error."""
    tokens = sequences.padded_tokens(_days(spark, folder), "session", ["line_id"], "token", length)
    return tokens.withColumn("y", (F.element_at("tokens", -1) == ord("e") - 96).cast("int"))


_ENDS = ("SELECT cast(user_id AS string) || '|' || strftime(ts, '%Y-%m-%d') AS session, "
         "cast(arg_max(event_type, event_id) = 'error' AS int) AS y FROM events GROUP BY 1")


@register("sequence_classifier", statement(
    "SELECT session, y, y AS pred FROM (SELECT *, row_number() OVER (ORDER BY session) AS k, count(*) OVER () AS n FROM ends) e "
    "WHERE k > n - cast(floor(n * 0.5) AS bigint)", ends=_ENDS))
def sequence_classifier(spark, folder):
    """Learnt on one half of the days, asked about the other."""
    rows = split.positional_split(_labelled_traces(spark, folder), "session", 0.0, 0.5, seed=None)
    model = sequence.fit_sequence(rows.where(F.col("split") == "train"))
    return model.transform(rows.where(F.col("split") == "test")).select("session", "y", "pred")


def _marked(label: Column) -> Column:
    """Events of days that end with an error are events of their own: every setting can tell them apart, at any scale."""
    return F.when(label == 1, 10).otherwise(0)


@register("model_selection", statement(
    "SELECT cast(epoch AS int) AS epoch, split, count(*) FILTER (WHERE y = 0) AS tn, 0::bigint AS fp, 0::bigint AS fn, "
    "count(*) FILTER (WHERE y = 1) AS tp, 1.0::double AS accuracy FROM (SELECT y, CASE WHEN k <= n - 2 * t THEN 'train' WHEN "
    "k <= n - t THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY session) AS k, count(*) OVER () "
    "AS n, cast(floor(count(*) OVER () * 0.1) AS bigint) AS t FROM ends) e) s, range(1, 4) r(epoch) "
    "WHERE split <> 'test' OR epoch = 1 GROUP BY ALL", ends=_ENDS))
def model_selection(spark, folder):
    traces = _labelled_traces(spark, folder)
    marked = F.transform("tokens", lambda t: F.when(t > 0, t + _marked(F.col("y"))).otherwise(t))
    found, _ = sequence.select_model(traces.withColumn("tokens", marked), "session", shared_path(spark, "model"), seed=None)
    return found.select("epoch", "split", "tn", "fp", "fn", "tp", "accuracy")


@register("save_best_model", statement("SELECT session, y AS pred FROM ends", ends=_ENDS))
def save_best_model(spark, folder):
    """Saved, loaded again and asked about raw events."""
    days = _days(spark, folder)
    last = days.groupBy("session").agg((F.max_by("event", "line_id") == "error").cast("int").alias("y"))
    days = days.join(last, "session").withColumn("event", F.concat("event", _marked(F.col("y")).cast("string"))).drop("y")
    codes = encode.lexical_rank(days, "event").withColumn("code", F.col("code") + 1)
    tokens = sequences.padded_tokens(
        encode.join_codes(days, codes, "event").withColumn("_token", F.col("code") + 1), "session", ["line_id"], "_token", 64)
    path = shared_path(spark, "model")
    sequence.select_model(tokens.join(last, "session"), "session", path, length=64, codes=codes)
    return sequence.SequenceClassifier.load(path).score_events(days, "session", ["line_id"], "event").select("session", "pred")


@register("benchmark_report")
def benchmark_report(spark, folder):
    rows = V.paired_counts(spark, folder)
    halves = split.stratified_split(rows, "session", "y", seed=None)
    return report.benchmark_report(halves, _PAIRED, "session", "y", contamination=0.1, max_distance=0.0, settings={
        "pca": {"components": 1, "weighting": "none", "threshold": 0.5}, "log_clustering": {"weighting": "none"}, "invariant_miner": {"keep": 0.8}})


# ---- the same functions on a stream -------------------------------------------------------------

def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = shared_path(spark, "streamed")
    run_to_end(stream, out, shared_path(spark, "state"))
    return spark.read.parquet(out)


@register("stream_events", statement("SELECT content, event_id, event_template, ts_s FROM ev", "ev"))
def stream_of_events(spark, folder):
    lines = stream_events(spark, _written_logs(spark, folder))
    return _streamed(spark, lines.select("content", "event_id", "event_template", epoch(F.col("ts")).alias("ts_s")))


@register("stream_unexpected_pairs", statement(
    "SELECT session, line_id, context, next FROM pairs WHERE (context, next) NOT IN (SELECT (context, next) FROM tops)",
    "traces", pairs=_PAIRS,
    tops="SELECT context, next FROM (SELECT context, next, row_number() OVER (PARTITION BY context ORDER BY count(*) DESC, "
         "next) AS place FROM pairs GROUP BY context, next) t WHERE place <= 3"))
def stream_unexpected_pairs(spark, folder):
    pairs = next_event_pairs(spark, folder)
    path = shared_path(spark, "pairs")
    pairs.write.parquet(path)
    followers = sized(next_event.top_followers(spark.read.parquet(path), 3))
    return _streamed(spark, unexpected_pairs(spark.readStream.schema(pairs.schema).parquet(path), followers))


#: A session ends with six hours of silence; it is final an hour after that.
_GAP_SESSIONS = """SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, count(*) AS events,
 count(*) FILTER (WHERE event_type = 'error') AS errors FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id
 ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR
 THEN 0 ELSE 1 END AS opens FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) e) s GROUP BY user_id, n"""


@register("stream_sessions", f"SELECT * FROM ({_GAP_SESSIONS}) q WHERE end_us <= (SELECT epoch_us(max(ts) - INTERVAL 1 HOUR) FROM events)")
def stream_sessions(spark, folder):
    """Sessions that are over when all events have been seen."""
    path = shared_path(spark, "clicks")
    clicks = V.table(spark, folder, "events").select("user_id", "ts", "event_type")
    clicks.write.parquet(path)
    found = sessions_by_gap(spark.readStream.schema(clicks.schema).parquet(path), "user_id", "6 hours", "1 hour",
                            errors=F.count_if(F.col("event_type") == "error"))
    return _streamed(spark, found.select(
        "user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events", "errors"))
