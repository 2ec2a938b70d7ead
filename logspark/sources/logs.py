"""Text logs and structured CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.session import sized


def scan_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One ``value`` per line, blank lines kept, bad bytes replaced."""
    return spark.read.text(path).select(F.make_valid_utf8("value").alias("value"))


def number_rows(rows: DataFrame, name: str = "line_id") -> DataFrame:
    """Add dense 1-based row numbers in file order (files by path) to a DataFrame read from files.

    Rows keep their place inside an input split, so only the rows per split have to be counted:
    their running sum, one number per split, is joined back. No sort and no shuffle of the rows:
    128 MB splits of 100 TB are 800,000 numbers, few enough to send to all tasks.
    """
    placed = rows.select(
        "*",
        F.monotonically_increasing_id().alias("_mid"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )
    splits = placed.groupBy("_file", "_start").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Running sum inside each file, then over files: no window sees more than the split list.
    in_file = W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_lines")).select(
        "_file", F.coalesce(F.sum("_lines").over(
            W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_file_offset"))
    offsets = splits.join(files, "_file").select(
        "_file", "_start",
        (F.col("_file_offset") + F.coalesce(F.sum("_n").over(in_file), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    numbered = placed.join(sized(offsets), ["_file", "_start"], "left")
    # Two scans that are split differently, as when executors come and go, must not lose lines in silence.
    offset = F.coalesce("_offset", F.raise_error(F.lit("the files were split differently on reading again")).cast("bigint"))
    return numbered.select((F.col("_mid") + offset).alias(name), *[F.col(f"`{c}`") for c in rows.columns])


def number_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``line_id, value`` of text files."""
    return number_rows(spark.read.text(path)).withColumn("value", F.make_valid_utf8("value"))


def load_structured(spark: SparkSession, path: str, multi_line: bool = False, order: str | None = None) -> DataFrame:
    """CSV of already templated lines: at least ``Content`` and ``EventId``.

    The order is that of the rows in the file, or that of the column ``order`` (a number) where one is named.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per file.
    """
    df = spark.read.csv(path, header=True, escape='"', multiLine=multi_line)
    missing = {"Content", "EventId"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if order is None:
        order, df = "_row", number_rows(df, "_row")
    return df.select(F.col(order).cast("bigint").alias("line_id"), F.col("Content").alias("content"), F.col("EventId").alias("event_id"))
