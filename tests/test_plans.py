"""Every registered plan against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from kairograph import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rel = duck.execute(SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted((tuple(plain(v) for v in r) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == expected


def test_flagship(spark):
    assert catalog.flagship(spark, SF).limit(1).count() == 1


def test_plain_filters_reach_the_scan(spark):
    plan = catalog.queries()["join_two_hop"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "embedding#" not in plan  # the widest column is not read
    assert os.path.exists(SF)
