"""Registered queries run on the smallest tables, and agree with their SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from waymark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalog.queries())


def plain(v):
    if v is None:
        return (0, "")
    return (1, round(v, 6)) if isinstance(v, float) else (2, str(v))


@pytest.fixture(scope="module")
def database(data):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, database, name):
    df = catalog.queries()[name](spark, data)
    sql = catalog.oracle_sql().get(name)
    rows = df.collect()
    if sql is None:
        return
    want = database.sql(sql)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
