"""Views the registered queries run on, derived by Spark from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators.features import occurrence_matrix
from logspark.operators.parse import structured_lines
from logspark.plans.dataset import narrow_events, tuples_of
from logspark.session import configure, spread, written

BLK = ("'blk_' || CASE WHEN {id} % 2 = 0 THEN '-' ELSE '' END || "
       "cast(7000000000 + {id} * 7919 AS STRING)")

# Line kinds by event_id % 37; written so that Spark and DuckDB render the same text.
MESSAGES = {
    1: "'Adding an already existing block ' || blk",
    2: "'Verification succeeded for ' || blk",
    3: "'10.0.0.1:50010 Served block ' || blk || ' to /10.0.0.2'",
    4: "'10.0.0.1:50010:Got exception while serving ' || blk || ' to /10.0.0.2:'",
    5: "'Receiving block ' || blk || ' src: /10.0.0.1:5 dest: /10.0.0.2:50010'",
    6: "'Received block ' || blk || ' src: /10.0.0.1:5 dest: /10.0.0.2:50010 of size 671'",
    7: "'writeBlock ' || blk || ' received exception java.io.IOException'",
    8: "'PacketResponder ' || blk || ' 1 for block ' || blk || ' Interrupted.'",
    9: "'Received block ' || blk || ' of size 671 from /10.0.0.1'",
    10: "'PacketResponder ' || blk || ' 2 Exception java.io.EOFException'",
    11: "'PacketResponder 1 for block ' || blk || ' terminating'",
    12: "'10.0.0.1:50010:Exception writing block ' || blk || ' to mirror 10.0.0.2:50010'",
    13: "'Receiving empty packet for block ' || blk",
    14: "'Exception in receiveBlock for block ' || blk || ' java.io.IOException'",
    15: "'Changing block file offset of block ' || blk || ' from 0 to 65536 meta file offset to 519'",
    16: "'10.0.0.1:50010:Transmitted block ' || blk || ' to /10.0.0.2:50010'",
    17: "'10.0.0.1:50010:Failed to transfer ' || blk || ' to 10.0.0.2:50010 got java.io.IOException'",
    18: "'10.0.0.1:50010 Starting thread to transfer block ' || blk || ' to 10.0.0.2:50010'",
    19: "'Reopen Block ' || blk",
    20: "'Unexpected error trying to delete block ' || blk || '. BlockInfo not found in volumeMap.'",
    21: "'Deleting block ' || blk || ' file /mnt/current/' || blk",
    22: "'BLOCK* NameSystem.allocateBlock: /user/root/part-0. ' || blk",
    23: "'BLOCK* NameSystem.delete: ' || blk || ' is added to invalidSet of 10.0.0.1:50010'",
    24: "'BLOCK* Removing block ' || blk || ' from neededReplications as it does not belong to any file.'",
    25: "'BLOCK* ask 10.0.0.1:50010 to replicate ' || blk || ' to datanode(s) 10.0.0.2:50010'",
    26: "'BLOCK* NameSystem.addStoredBlock: blockMap updated: 10.0.0.1:50010 is added to ' || blk || ' size 671'",
    27: "'BLOCK* NameSystem.addStoredBlock: Redundant addStoredBlock request received for ' || blk || "
        "' on 10.0.0.1:50010 size 671'",
    28: "'BLOCK* NameSystem.addStoredBlock: addStoredBlock request received for ' || blk || "
        "' on 10.0.0.1:50010 size 671 But it does not belong to any file.'",
    29: "'PendingReplicationMonitor timed out block ' || blk",
    30: "'BLOCK* ask 10.0.0.1:50010 to delete ' || blk || ' ' || blk2",
    31: "'RECEIVING BLOCK ' || blk || ' SRC: /10.0.0.1:5 DEST: /10.0.0.2:50010'",
    32: "'Node heartbeat lost with no session key in this line ' || cast(event_id AS STRING)",
    35: "'Deleting block ' || blk || ' file /mnt/current/' || blk || '_' || cast(event_id AS STRING) || '.meta'",
    0: "'Received block ' || blk || ' src: /10.0.0.1:5 dest: /10.0.0.2:50010 of size 671 from /10.0.0.1'",
    36: "'PacketResponder 3 for block ' || blk || ' Exception java.io.IOException terminating'",
}

SPARK_TS = "date_format(ts, 'yyMMdd HHmmss')"
DUCKDB_TS = "strftime(ts, '%y%m%d %H%M%S')"


def raw_logs_sql(ts_text: str) -> str:
    """Rendered log lines from ``events``: every template, and lines that are odd in some way."""
    cases = "\n".join(f"  WHEN {kind} THEN {text}" for kind, text in MESSAGES.items())
    return f"""SELECT event_id AS line_id, CASE
 WHEN event_id % 37 = 33 THEN 'java.io.IOException: connection reset near ' || blk
 WHEN event_id % 37 = 34 THEN ''
 ELSE {ts_text} || ' ' || cast(user_id + 100 AS STRING) || ' ' || lvl || ' ' || comp || ': ' || msg END AS value
FROM (SELECT event_id, ts, user_id, blk,
  CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END AS lvl,
  CASE WHEN event_id % 2 = 0 THEN 'dfs.DataNode$DataXceiver' ELSE 'dfs.FSNamesystem' END AS comp,
  CASE event_id % 37
{cases}
  ELSE 'Receiving block ' || blk || ' src: /10.0.0.3:5 dest: /10.0.0.4:50010' END AS msg
 FROM (SELECT event_id, ts, user_id, event_type, {BLK.format(id='user_id')} AS blk,
   'blk_' || cast(7000000001 + (user_id + 1) * 7919 AS STRING) AS blk2
  FROM events) a) b"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_logs(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return spark.sql(raw_logs_sql(SPARK_TS).replace("FROM events)", "FROM {events})"),
                     events=spread(table(spark, folder, "events"), "event_id"))


def block_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.expr(BLK.format(id="doc_id")).alias("block_id"), F.col("toxic").alias("label"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Rendered lines, parsed and matched."""
    return structured_lines(raw_logs(spark, folder))


def staged_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a narrow table, written once: a query that looks twice parses once."""
    return written(narrow_events(events(spark, folder)), "events")


def tuples(spark: SparkSession, folder: str) -> DataFrame:
    return tuples_of(staged_events(spark, folder))


def event_traces(spark: SparkSession, folder: str) -> DataFrame:
    """``session, line_id, event, token, ts`` per user."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("line_id"),
        F.col("event_type").alias("event"),
        (F.ascii("event_type") - 96).cast("bigint").alias("token"), "ts")


def turn_traces(spark: SparkSession, folder: str) -> DataFrame:
    """``session, pos, event, token`` per conversation: short traces."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.col("role").alias("event"),
        (F.ascii("role") - 96).cast("bigint").alias("token"))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), (F.col("value") / 500.0).alias("prob"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        F.to_date("ts").alias("day"))


DAILY_EVENTS = ["click", "error", "purchase", "signup", "view"]


def daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``session, <one count per event type>, y`` per user and day."""
    rows = table(spark, folder, "events").select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session"),
        "event_type")
    return occurrence_matrix(rows, DAILY_EVENTS, "session", "event_type").withColumn(
        "y", (F.col("error") >= 2).cast("int"))


PAIRED_EVENTS = ["opened", "closed", "checked"]


def paired_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``session, opened, closed, checked, y`` per user and day: each event is opened, checked twice and closed; some
    errors are never closed, which breaks the balance of their sessions (y = 1)."""
    rows = table(spark, folder, "events")
    lost = (F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)
    count = F.count(F.lit(1))
    return rows.groupBy(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session")).agg(
        count.cast("int").alias("opened"), F.count_if(~lost).cast("int").alias("closed"), (2 * count).cast("int").alias("checked"),
        (F.count_if(lost) > 0).cast("int").alias("y"))


def vector_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """``id, x, y``: each vector as one step of a feature sequence."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.array("embedding").alias("x"), F.col("label").alias("y"))


def free_text(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines as log lines without header."""
    return spread(table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "value")).select(
        (F.col("doc_id") * 1_000_000 + F.col("n")).alias("line_id"), "value")


ROLES = ["assistant", "system", "user"]


def role_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``session, <one count per role>``: nearly as many answers as questions."""
    return occurrence_matrix(turn_traces(spark, folder), ROLES, "session", "event")
