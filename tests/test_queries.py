"""Every query that has SQL against DuckDB, over the smallest tables."""

import datetime
import importlib
import os

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
plans = {k: f for m in map(importlib.import_module, entry.MODULES) for k, f in m.QUERIES.items()}
sql = {k: s for m in map(importlib.import_module, entry.MODULES) for k, s in m.ORACLE_SQL.items()}


def plain(x):
    if hasattr(x, "asDict"):
        return tuple(x)
    if isinstance(x, float):
        return None if x != x else int(x) if x == int(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


def test_all_queries_have_sql():
    assert set(plans) == set(sql)


@pytest.mark.parametrize("name", sorted(sql))
def test_query(spark, duck, name):
    df = plans[name](spark, FOLDER)
    want = duck.sql(sql[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
