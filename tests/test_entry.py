"""Every query with SQL gives the same rows as its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import normal_rows

FOLDER = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not entry.queries()[k].__module__.startswith("graphloom.llm")}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        table = name.removesuffix(".parquet")
        path = f"{FOLDER}/{name}" if os.path.isfile(f"{FOLDER}/{name}") else f"{FOLDER}/{name}/*.parquet"
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = entry.queries()[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert normal_rows(found.columns, [tuple(r) for r in found.collect()]) == normal_rows(columns, want.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() >= 0
