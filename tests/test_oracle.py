"""Registered queries against their SQL on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from lattica.plans.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def results(spark, request):
    """Rows of the chosen queries, a few of which run at a time, as most of their time is planning."""

    def run(name):
        df = QUERIES[name](spark, DIR)
        cols = sorted(df.columns)
        return cols, [tuple(r) for r in df.select(*cols).collect()]

    names = [x.callspec.params["name"] for x in request.session.items if getattr(x, "originalname", "") == "test_query_matches_sql"]
    pool = ThreadPoolExecutor(4)
    yield {name: pool.submit(run, name) for name in names}
    pool.shutdown(cancel_futures=True)


def _order(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, (int, float)) else "n"), 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(results, con, name):
    cols, got = results[name].result()
    got = sorted(got, key=_order)
    r = con.sql(SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=_order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-5, abs=2e-6)) for x, y in zip(a, b)), (a, b)
