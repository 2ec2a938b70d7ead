"""Every registered query with SQL gives the rows DuckDB gives on the same tables."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    assert compare(queries()[name](spark, FOLDER), db, SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
