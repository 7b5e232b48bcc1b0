"""Each query with SQL against DuckDB on the smallest tables; all others must run."""

from __future__ import annotations

import math
import os
from collections import Counter

import pytest

from quern.plans import queries, sql

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def compare(spark, duck, query, statement):
    df = query(spark, DIR)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = duck.execute(statement)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    assert got == Counter(tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, duck, name):
    compare(spark, duck, queries.queries()[name], sql.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_runs(spark, name):
    df = queries.queries()[name](spark, DIR)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
