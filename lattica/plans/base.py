"""Registration of queries, and the test tables bound to the schema of posts.

Each binding is given twice: as a DataFrame and as a common table expression for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import AFFECT, pack_bits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Affect scores of the fixture count from this one on.
THRESHOLD = 0.15


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def min_posts(sf_dir: str) -> int:
    return 20


# --- posts -------------------------------------------------------------------------------------

POSTS = """posts AS (
    SELECT o_orderkey AS key, CAST(o_orderdate AS TIMESTAMP) AS created_utc, o_totalprice AS score,
           CASE WHEN o_orderkey % 11 = 0 THEN 'NO_TEMPLATE' WHEN o_orderkey % 3 = 0 THEN t
                WHEN o_orderkey % 3 = 1 THEN lower(t) ELSE replace(t, '_', ' ') END AS template_final
    FROM (SELECT orders.*, c_mktsegment || '_' || n_name AS t FROM orders
          JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""

PREPARED = (
    POSTS
    + """, prepared AS (
    SELECT *, regexp_replace(lower(template_final), '[^a-z0-9]+', '', 'g') AS template_key,
           CAST(date_trunc('month', created_utc) AS DATE) AS month
    FROM posts WHERE template_final NOT IN ('NO_TEMPLATE', 'NON_MEME', 'NO_MEME', '') AND created_utc IS NOT NULL)"""
)


def posts(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    t = F.concat_ws("_", "c_mktsegment", "n_name")
    label = F.when(F.col("o_orderkey") % 11 == 0, "NO_TEMPLATE").when(F.col("o_orderkey") % 3 == 0, t).when(F.col("o_orderkey") % 3 == 1, F.lower(t)).otherwise(F.replace(t, F.lit("_"), F.lit(" ")))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation has 25 rows at any scale
    return joined.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("created_utc"), F.col("o_totalprice").alias("score"), label.alias("template_final"))


# --- affect ------------------------------------------------------------------------------------


def _affect_sql(context: str, offset: int) -> str:
    return ", ".join(f"CASE WHEN vec_id % 17 <> 0 THEN abs(CAST(embedding[{i + offset + 1}] AS DOUBLE)) END AS {k}_{context}" for i, k in enumerate(AFFECT))


AFFECTS = f"affect AS (SELECT vec_id AS key, label AS topic, {_affect_sql('global', 0)}, {_affect_sql('local', 14)} FROM embeddings)"


def affect(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")

    def score(i: int):
        return F.when(F.col("vec_id") % 17 != 0, F.abs(F.col("embedding")[i].cast("double")))

    cols = [score(i + o).alias(f"{k}_{c}") for c, o in (("global", 0), ("local", 14)) for i, k in enumerate(AFFECT)]
    return e.select(F.col("vec_id").alias("key"), F.col("label").alias("topic"), *cols)


def scores(context: str, labels=AFFECT) -> dict[str, str]:
    return {k: f"{k}_{context}" for k in labels}


def dominant_sql(context: str, labels=AFFECT) -> str:
    """DuckDB: struct (label, score) of the largest score, first label first."""
    items = ", ".join(f"{{'s': {k}_{context}, 'o': {-i}, 'l': '{k}'}}" for i, k in enumerate(labels))
    return f"list_max(list_filter([{items}], lambda x: x.s IS NOT NULL))"


DOMINANT = (
    AFFECTS
    + f""", dom AS (
    SELECT key, topic, coalesce(g.l, 'unavailable') AS global_label, g.s AS global_score, coalesce(l.l, 'unavailable') AS local_label, l.s AS local_score
    FROM (SELECT *, {dominant_sql('global')} AS g, {dominant_sql('local')} AS l FROM affect))"""
)

# --- texts -------------------------------------------------------------------------------------

TEXTS = """texts AS (
    SELECT doc_id AS key, split_part(text, chr(10), 1) AS global_text, text AS local_text, lang AS class,
           CASE WHEN doc_id % 13 = 0 THEN -1 ELSE CAST(substr(source, 4) AS INTEGER) END AS topic, (doc_id % 100) / 100.0::DOUBLE AS probability
    FROM documents)"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    topic = F.when(F.col("doc_id") % 13 == 0, -1).otherwise(F.substr("source", F.lit(4)).try_cast("int"))
    return t.select(F.col("doc_id").alias("key"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("global_text"), F.col("text").alias("local_text"), F.col("lang").alias("class"), topic.alias("topic"), ((F.col("doc_id") % 100) / 100.0).alias("probability"))


# --- vectors and hashes ------------------------------------------------------------------------

#: Rows of the vectors used for testing against the others.
VECTORS = """vectors AS (
    SELECT vec_id AS key, label AS template, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
           vec_id % 5 = 0 AS is_test FROM embeddings)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("key"), F.col("label").alias("template"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("vec_id") % 5 == 0).alias("is_test"))


#: 64 signs of a vector as bits; six copies of the first vectors flip the lowest 0 to 5 bits.
HASHES = """hashes AS (
    SELECT vec_id * 6 + j AS key, label AS template, xor(h, (CAST(1 AS BIGINT) << j) - 1) AS hash
    FROM (SELECT vec_id, label, CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) AS BIGINT) AS h
          FROM embeddings), (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS j)
    WHERE j = 0 OR vec_id < 60)"""


def hashes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", pack_bits(F.transform(F.slice("embedding", 1, 63), lambda x: x > 0)).alias("h"))
    e = e.withColumn("j", F.explode(F.when(F.col("vec_id") < 60, F.array(*map(F.lit, range(6)))).otherwise(F.array(F.lit(0)))))
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j")) - 1
    return e.select((F.col("vec_id") * 6 + F.col("j")).alias("key"), F.col("label").alias("template"), F.col("h").bitwiseXOR(flip).alias("hash"))


NAMES = """names AS (SELECT DISTINCT p_name AS name FROM part), candidates AS (
    SELECT row_number() OVER (ORDER BY name) AS row_id, name FROM (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part UNION SELECT n_name FROM nation))"""


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")
