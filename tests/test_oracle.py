"""Every registered metric query against its SQL oracle (DuckDB) on the smallest tables."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
CORE = E.core_registry()      # corpus queries are tested in tests/llm
SQL = {k: v[1] for k, v in CORE.items() if v[1] is not None}
QUERIES = {k: v[0] for k, v in CORE.items()}


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.date().isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    got = df.collect()
    cur = duck.execute(SQL[key])
    dcols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(dcols, want)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "week_start" in df.columns
