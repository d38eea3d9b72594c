"""Registered queries against their SQL on small tables made for one case."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.operators import text
from lattica.plans.registry import QUERIES, SQL


def _same(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return math.isnan(x) and math.isnan(y) or x == y or abs(x - y) <= 2e-6
    return x == y


def agrees(spark, name, d, **tables):
    """The query's rows over the tables (rows, schema), which are those of its SQL."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(d))
    cols = sorted(df.columns)
    r = con.sql(SQL[name])
    at = [r.columns.index(c) for c in cols]

    def order(row):
        return [(x is None, isinstance(x, str), str(x) if isinstance(x, str) else 0, 0 if x is None or isinstance(x, str) else x) for x in row]

    got = sorted((tuple(x) for x in df.select(*cols).collect()), key=order)
    want = sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(_same, a, b)), (a, b)
    return got


def test_standardise_of_a_feature_without_spread(spark, tmp_path):
    # Both templates have a post in each of the two months, one of them more.
    orders = [(i + 1, c, datetime.datetime(1995, m, 3), 1.0) for i, (c, m) in enumerate([(0, 1), (0, 2), (1, 1), (1, 2), (1, 2)])]
    got = agrees(
        spark, "standardise", tmp_path,
        orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double"),
        customer=([(0, "A", 0), (1, "B", 0)], "c_custkey long, c_mktsegment string, c_nationkey int"),
        nation=([(0, "X")], "n_nationkey int, n_name string"),
    )
    assert all(math.isnan(ratio) and abs(hhi) == 1 for ratio, hhi, _ in got)


def test_bh_qvalues_of_ties_over_many_partitions(spark, tmp_path):
    # Every value is held by several rows, one by half of them; ratios rise and fall.
    rows = [(i, [0.5 if i % 2 else (i * i % 97) / 97.0], 0) for i in range(600)] + [(600, [float("nan")], 0), (603, [0.0], 0)]
    got = agrees(spark, "bh_qvalues", tmp_path, embeddings=([(i, v + [0.1] * 63, k) for i, v, k in rows], "vec_id long, embedding array<float>, label int"))
    assert len({q for _, q in got}) > 5


def test_bh_qvalues_plan_reads_no_frame_forward(spark):
    from lattica.operators import statistics

    t = spark.createDataFrame([(i, i / 100.0) for i in range(100)] + [(100, None)], "key long, p double")
    q = statistics.bh_qvalues(t, "p", "key")
    assert "unboundedfollowing" not in q._jdf.queryExecution().analyzed().toString().lower()
    got = {r["key"]: r["q"] for r in q.collect()}
    assert got[100] is None and abs(got[50] - 50 / 100 * 100 / 51) < 1e-12 and got[0] == 0.0


_VECTOR = "vec_id long, embedding array<float>, label int"


def test_silhouette_of_copies_and_rows_without_cluster(spark, tmp_path):
    rows = [(i, [float((i * 7 + j * j) % 5 if i % 3 else j % 4) for j in range(64)], i % 4) for i in range(40)]
    rows += [(100, rows[0][1], None), (101, None, 1), (102, rows[1][1], 9), (None, rows[2][1], 1)]
    assert len(agrees(spark, "silhouette", tmp_path, embeddings=(rows, _VECTOR))) == 1


def test_silhouette_of_one_row(spark, tmp_path):
    assert agrees(spark, "silhouette", tmp_path, embeddings=([(1, [1.0] * 64, 1)], _VECTOR)) == [(None,)]


def test_silhouette_works_out_a_pair_of_blocks_once():
    import numpy as np
    import pyarrow as pa

    from lattica.operators.cluster import _distance_sums

    g = np.random.default_rng(3)
    x, y = g.normal(size=(150, 3)), g.normal(size=(70, 3))
    y[:2] = x[:2]

    def table(v, first, names):
        n = len(v)
        return pa.table({"key": np.arange(first, first + n), "cluster": np.arange(n) * 7 % 3, "v": v.tolist(), "w": np.arange(n) % 2 + 1, **{k: np.full(n, b) for k, b in names.items()}})

    got = {(k, c): s for k, c, s in zip(*(z.to_pylist() for z in _distance_sums(table(x, 0, {"b": 0, "c": 1}), table(y, 1000, {"b2": 0, "c2": 1})).columns))}
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    for first, e, n in ((0, d, len(y)), (1000, d.T, len(x))):
        of, w = np.arange(n) * 7 % 3, np.arange(n) % 2 + 1
        for i in range(len(e)):
            for c in range(3):
                assert abs(got.pop((first + i, c)) - (e[i] * w)[of == c].sum()) < 1e-9
    assert not got


def test_silhouette_of_equal_vectors_is_that_of_its_sql(spark, tmp_path):
    rows = [(i, [1.0] * 64, i % 2) for i in range(4)]
    assert math.isnan(agrees(spark, "silhouette", tmp_path, embeddings=(rows, _VECTOR))[0][0])


_DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Frequent and rare words, repeated documents, a doc_id twice, empty texts, none, and none that counts.
_TEXTS = [(i, f"alpha word{i % 3} word{i % 3}\nalpha beta{i} word{i % 7} gamma gamma", "en" if i % 2 else "fr", f"src{i % 4}", 1) for i in range(30)]
_TEXTS += [(30, _TEXTS[0][1], "en", "src1", 1), (30, "delta alpha\nalpha", "en", "src1", 1), (31, "", "en", "src2", 0), (32, None, "fr", "src2", None), (33, "a 12 ..", "fr", "src3", 7)]


@pytest.mark.parametrize("frequent", [3, 200_000])
@pytest.mark.parametrize("name", ["tfidf_docs", "text_pair_cosine", "class_keywords_tfidf", "topic_labels"])
def test_tfidf_with_tokens_that_are_not_broadcast(spark, tmp_path, monkeypatch, name, frequent):
    monkeypatch.setattr(text, "FREQUENT", frequent)
    rows = [x for x in _TEXTS if name != "class_keywords_tfidf" or x[0] != 30]  # its SQL joins texts by key
    assert agrees(spark, name, tmp_path, documents=(rows, _DOCUMENT))


def test_tfidf_shuffles_no_row_of_a_frequent_token(spark, tmp_path):
    df = spark.createDataFrame(_TEXTS, _DOCUMENT)
    w = text.tfidf(df, "doc_id", F.split("text", " "))
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
