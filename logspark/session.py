"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL_SETTINGS = {
    # Log timestamps carry no zone; UTC makes results the same on every machine.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "logspark", master: str | None = None, **settings: str) -> SparkSession:
    """A session with our SQL settings; cluster sizing comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Checkpoint files go when nothing refers to them any more.
    cleaning = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in {**SQL_SETTINGS, **cleaning, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session somebody else made."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Where it is unset, a folder below the warehouse. On a cluster that is an error if the warehouse is a folder of one
    machine: other executors could not read what is written there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
        if not context.master.startswith("local") and re.match(r"(file:|/|[^:]+$)", folder):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder; what is written there is taken away when the Python session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def written(df: DataFrame, name: str = "staged") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: columns can still be pruned, filters pushed down."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: set[str] = set()


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if not _STAGED:
        atexit.register(remove_staged, spark)
    _STAGED.add(path)


def remove_staged(spark: SparkSession) -> None:
    """Delete what was written below the paths that ``shared_path`` gave, if the session still runs."""
    try:
        context = spark.sparkContext
        for path in sorted(_STAGED):
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass
    _STAGED.clear()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder so later branches read the same rows.

    Reliable checkpoint: a lost executor costs a re-read, never a recomputation that could differ.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A join side that is sent to all tasks if it is small.

    It is written once and measured. Beyond ``max_rows`` or ``max_bytes`` (as text) it stays an ordinary join side,
    which Spark shuffles and, where a key is hot, splits. The rows of the join are the same either way.
    """
    staged = stage(df)
    width = sum((F.coalesce(F.length(F.col(f"`{name}`").cast("string")), F.lit(0)) for name in df.columns), F.lit(16))
    rows, size = staged.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(staged) if rows <= max_rows and size <= max_bytes else staged


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give an input with fewer splits than cores (a single small file) to all cores.

    Large inputs have splits enough and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
