"""Every registered query of the reference operators against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(registry._registry().QUERIES)

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    out = registry._registry().QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    rows = ordered(tuple(plain(r[c]) for c in columns) for r in out.select(*columns).collect())
    sql = registry._registry().SQL.get(name)
    if sql is None:
        assert rows or name.startswith("x"), "a query over the tables gives rows"
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    assert rows == ordered(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_names_and_sql_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(OWN) >= 150


def test_entry(spark):
    assert registry.entry(spark).count() > 0
