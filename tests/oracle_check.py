"""Run the registered queries beside their SQL and compare rows: ``python tests/oracle_check.py [sf] [name...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, db, sql):
    """Problem text, or None when columns and rows are equal."""
    got = normal_rows(df.columns, df.collect())
    result = db.execute(sql)
    types = [(d[0], str(d[1])) for d in result.description]
    want = normal_rows([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    for g, w in zip(got[1], want[1]):
        if repr(g) != repr(w):
            return f"{str(g)[:300]}\n   != {str(w)[:300]}"
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}
    for (name, kind) in df.dtypes:
        expected = dict(types)[name]
        if kinds.get(kind, kind) != expected and not (kind == "string" and expected == "STRING"):
            return f"rows equal, but type of {name}: {kind} / {expected}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from logspark.session import build_session

    args = sys.argv[1:]
    folder = f"/root/testdata/sf{args.pop(0) if args else '0.01'}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls, failed = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            problem = compare(df, db, sqls[name]) if name in sqls else None
            note = "" if name in sqls else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, note = f"{type(error).__name__}: {str(error)[:700]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
        if problem:
            print("   " + problem, flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
