"""Every registered query that has SQL, on the smallest tables, against DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import pytest

from tarnwork.queries import MODULES, collect

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = collect("tarnwork.queries", MODULES)
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return str(v.normalize() + 0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    want = sorted((tuple(plain(r[have.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.collect()
