"""Every query against its SQL, at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lexigrain.plans import oracle, queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda x: round(x, 4) if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(fix(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("query", queries.QUERIES, ids=lambda f: f.__name__)
def test_query(spark, duck, query):
    df = query(spark, DIR)
    got = rows(df.columns, df.collect())
    sql = oracle.SQL.get(query.__name__)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())
