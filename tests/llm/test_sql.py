"""Queries of the corpus operators against their SQL on the smallest tables."""

import duckdb
import pytest

from lattica.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, con, name):
    r = con.sql(SQL[name])
    got = QUERIES[name](spark, DIR).select(*r.columns).collect()
    want = r.fetchall()
    assert len(got) == len(want) > 0
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
