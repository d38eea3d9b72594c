"""Queries on readers, writers, record parsing and label provenance."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import relational as rel
from ..sources import ingest as io
from .base import POSTS, PREPARED, posts, query, table
from .popularity import _prepared


def _folder(spark) -> str:
    """A new folder in the shared one that the session names; in local mode without it, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lattica-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _lines(spark, d):
    """Posts as nested JSON lines: every fiftieth is malformed, every tenth has no object as data."""
    k = F.col("o_orderkey")
    data = F.to_json(F.struct(F.col("o_orderpriority").alias("template"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("pred_template"), F.array(F.lit("a"), F.lit("b")).alias("global_context_keywords")))
    line = F.concat(F.lit('{"key": "'), k.cast("string"), F.lit('", "data": '), F.when(k % 10 == 0, "[1]").otherwise(data), F.lit("}"))
    return table(spark, d, "orders").select(F.when(k % 50 == 1, '{"key": ').otherwise(line).alias("value"))


@query("read_nested_jsonl", "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS template_original, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS pred_template, 'a | b' AS global_keywords FROM orders WHERE o_orderkey % 50 <> 1 AND o_orderkey % 10 <> 0")
def read_nested_jsonl(spark, d):
    path = _folder(spark)
    _lines(spark, d).write.text(path)
    return io.read_nested_jsonl(spark, path).select("key", "template_original", "pred_template", "global_keywords")


@query("flatten_records", "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS template FROM orders WHERE o_orderkey % 50 <> 1 AND o_orderkey % 10 <> 0")
def flatten_records(spark, d):
    return io.parse_annotations(_lines(spark, d)).select("key", F.col("template_original").alias("template"))


@query("label_provenance_fallback", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS template_final, CASE WHEN o_orderkey % 3 = 0 THEN 'prediction' ELSE 'original' END AS template_source FROM orders WHERE o_orderkey % 50 <> 1 AND o_orderkey % 10 <> 0")
def label_provenance_fallback(spark, d):
    return io.provenance(io.parse_annotations(_lines(spark, d))).select("key", "template_final", "template_source")


@query("label_provenance_strict", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'NO_TEMPLATE' END AS template_final, CASE WHEN o_orderkey % 3 = 0 THEN 'closed_set_assignment' ELSE 'closed_set_no_template' END AS template_source FROM orders WHERE o_orderkey % 50 <> 1 AND o_orderkey % 10 <> 0")
def label_provenance_strict(spark, d):
    return io.provenance_strict(io.parse_annotations(_lines(spark, d))).select("key", "template_final", "template_source")


@query("read_affect_jsonl", "SELECT CAST(vec_id AS VARCHAR) AS key, round(abs(CAST(embedding[2] AS DOUBLE)), 6) AS joy_global, round(abs(CAST(embedding[3] AS DOUBLE)), 6) AS positive_global, CAST(NULL AS DOUBLE) AS anger_global FROM embeddings")
def read_affect_jsonl(spark, d):
    e = [F.abs(F.col("embedding")[i].cast("double")) for i in range(3)]
    emotions = F.array(F.struct(F.lit("joy").alias("label"), e[0].alias("score")), F.struct(F.lit("joy").alias("label"), e[1].alias("score")), F.struct(F.lit("other").alias("label"), e[2].alias("score")))
    line = F.to_json(F.struct(F.col("vec_id").cast("string").alias("key"), emotions.alias("global_emotions"), F.create_map(F.lit("positive"), e[2]).alias("global_sentiments")))
    a = io.parse_affect(table(spark, d, "embeddings").select(line.alias("value")))
    return a.select("key", F.round("joy_global", 6).alias("joy_global"), F.round("positive_global", 6).alias("positive_global"), "anger_global")


def _keyed(spark, d, cut: bool):
    """Documents of topics, of five hundred records at most."""
    k = F.col("doc_id")
    record = F.concat(F.lit('"'), k.cast("string"), F.lit('": {"topic": '), (k % 7).cast("string"), F.lit(', "probability": '), ((k % 100) / 100).cast("string"), F.lit("}"))
    docs = table(spark, d, "documents").groupBy(F.floor(k / 500).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(record)), ", ").alias("v"))
    return docs.select(F.concat(F.lit("{"), "v", F.lit(', "cut": {"topic": 1, "pro' if cut else "}")).alias("value"))


@query("read_keyed_json", "SELECT CAST(doc_id AS VARCHAR) AS key, CAST(doc_id % 7 AS INTEGER) AS topic, (doc_id % 100) / 100.0::DOUBLE AS probability FROM documents")
def read_keyed_json(spark, d):
    return io.parse_keyed_json(_keyed(spark, d, False))


@query("read_truncated_json", "SELECT CAST(doc_id AS VARCHAR) AS key, CAST(doc_id % 7 AS INTEGER) AS topic, (doc_id % 100) / 100.0::DOUBLE AS probability FROM documents")
def read_truncated_json(spark, d):
    return io.parse_truncated_json(_keyed(spark, d, True))


@query("read_parquet_pruned", "SELECT o_orderkey AS key, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def read_parquet_pruned(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), "o_orderstatus")


def _in_order(df, key):
    """Rows in the order of a key, over the files by their names and in each file."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


@query("read_csv_typed", "SELECT name, type, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS row_id FROM (SELECT p_name AS name, arg_min(p_type, p_partkey) AS type FROM part GROUP BY 1)")
def read_csv_typed(spark, d):
    path = _folder(spark)
    _in_order(table(spark, d, "part"), "p_partkey").select(F.col("p_name").alias("name"), F.col("p_type").alias("type")).write.csv(path, header=True)
    return io.read_csv_typed(spark, path, ["name", "type"], "name").select("name", "type", "row_id")


@query("read_headerless_csv2", "SELECT p_name AS key, arg_min(p_type, p_partkey) AS value FROM part GROUP BY 1")
def read_headerless_csv2(spark, d):
    path = _folder(spark)
    _in_order(table(spark, d, "part"), "p_partkey").select("p_name", "p_type").write.csv(path)
    return io.read_headerless_csv(spark, path)


@query("scan_labelled_tree", "SELECT 'lang=' || lang AS template, 'tree' AS source FROM documents GROUP BY 1")
def scan_labelled_tree(spark, d):
    path = _folder(spark)
    table(spark, d, "documents").select("lang", F.lit("x").alias("value")).write.partitionBy("lang").text(path)
    return io.scan_labelled_tree(spark, path, ("txt",)).select("template", "source").distinct()


@query("normalise_manifest", "SELECT '/new/' || p_partkey || '.jpg' AS image_path, p_brand AS template, 'train' AS source FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY '/new/' || p_partkey || '.jpg') AS r FROM part) WHERE r <= 5")
def normalise_manifest(spark, d):
    m = table(spark, d, "part").select(F.concat(F.lit("/old/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"), F.col("p_brand").alias("template_name"))
    return io.normalise_manifest(m, "train", "/old/", "/new/", None, 5)


@query("build_post_table", f"WITH {POSTS} SELECT count(*) AS posts, count(l_orderkey) AS with_metadata, count(DISTINCT template_final) AS templates FROM posts LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON key = l_orderkey")
def build_post_table(spark, d):
    meta = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")).distinct().withColumn("meta", F.lit(1))
    path = _folder(spark)
    io.write_outputs(posts(spark, d).join(meta, "key", "left"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("posts"), F.count("meta").alias("with_metadata"), F.count_distinct("template_final").alias("templates"))


@query("upsert_jsonl", "SELECT updated, count(*) AS n FROM (SELECT o_orderkey % 4 = 0 AS updated FROM orders) GROUP BY 1")
def upsert_jsonl(spark, d):
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select(k.alias("key"), F.col("o_orderstatus").alias("label"), F.lit("original").alias("source"))
    path = _folder(spark)
    io.write_outputs(io.upsert_records(r, r.where("key % 4 = 0").select("key", F.lit("new").alias("label"))), path, "json")
    return spark.read.schema("key long, label string, source string, updated boolean").json(path).groupBy("updated").agg(F.count("*").alias("n"))


@query("upsert_decision", "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'changed' ELSE p_brand END AS decision FROM part")
def upsert_decision(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("decision"))
    return rel.upsert(p, p.where("key % 3 = 0").select("key", F.lit("changed").alias("decision")), "key").orderBy("key")


@query("append_cache_by_key", "SELECT user_id AS key, max_by(value, event_id) AS value FROM events GROUP BY 1")
def append_cache_by_key(spark, d):
    e = table(spark, d, "events").select(F.to_json(F.struct(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value")).alias("line"))
    bad = e.limit(1).select(F.lit("{broken").alias("line"))
    x = e.unionByName(bad).select(F.from_json("line", "struct<key: long, seq: long, value: double>").alias("r")).where("r.key is not null").select("r.*")
    return rel.last_per_key(x, "key", "seq").select("key", "value")


@query("request_manifest", "SELECT p_name AS template, CASE WHEN min(p_partkey) % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime_type FROM part GROUP BY 1")
def request_manifest(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("template")).agg(F.min("p_partkey").alias("k"))
    m = io.request_manifest(p.select("template", F.lit(1).alias("cluster"), F.concat(F.lit("/img/"), F.col("k").cast("string"), F.when(F.col("k") % 2 == 0, ".png").otherwise(".jpg")).alias("path")), "when?")
    return m.select(F.get_json_object("value", "$.template").alias("template"), F.get_json_object("value", "$.mime_type").alias("mime_type"))


@query("write_outputs", f"WITH {PREPARED} SELECT key, template_key, round(score, 2) AS score FROM prepared")
def write_outputs(spark, d):
    path = _folder(spark)
    io.write_outputs(_prepared(spark, d).select("key", "template_key", "score"), path, "json")
    return spark.read.schema("key long, template_key string, score double").json(path).select("key", "template_key", F.round("score", 2).alias("score"))


@query("missing_files", "SELECT doc_id AS key, 'https://img.example/' || doc_id || '.jpg' AS source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_files(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit("https://img.example/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("source"))
    return io.missing_files(e, table(spark, d, "labels").select(F.col("doc_id").alias("key")))


@query("parse_polymorphic_list", "SELECT event_id AS key, CASE event_id % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a,b' ELSE event_type END AS items FROM events")
def parse_polymorphic_list(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, '["a", " ", "b "]').when(k == 1, "a | b || ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(F.col("event_id").alias("key"), F.array_join(sc.parse_polymorphic_list(raw), ",").alias("items"))


@query("list_to_text", "SELECT event_id AS key, event_type || ' | x' AS t FROM events")
def list_to_text(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("key"), sc.list_to_text(F.array("event_type", F.lit(" "), F.lit("x "))).alias("t"))


@query("list_to_json", "SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN '[\"' || event_type || '\"]' ELSE '[]' END AS t FROM events")
def list_to_json(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("key"), sc.list_to_json(F.when(F.col("event_id") % 2 == 0, F.array("event_type"))).alias("t"))


@query("scalar_or_first", "SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN event_type END AS first FROM events")
def scalar_or_first(spark, d):
    a = F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select(F.col("event_id").alias("key"), F.try_element_at(a, F.lit(1)).alias("first"))


@query("response_json_parse", "SELECT event_id AS key, CASE WHEN event_id % 4 <> 3 THEN event_type END AS label, CASE WHEN event_id % 5 <> 0 THEN 2001 END AS first_year, event_id % 4 <> 3 AS valid FROM events")
def response_json_parse(spark, d):
    k = F.col("event_id")
    label = F.when(k % 4 == 3, "unheard of").otherwise(F.col("event_type"))
    text = F.concat(F.when(k % 2 == 0, "Sure:\n```json\n").otherwise(""), F.lit('{"label": "'), label, F.lit('", "first_year": '), F.when(k % 5 == 0, "1875").otherwise("2001"), F.lit("}"), F.when(k % 2 == 0, "\n```").otherwise(""))
    e = table(spark, d, "events")
    known = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(100).collect()]  # the few known labels
    return e.select(k.alias("key"), *(c.alias(n) for n, c in io.parse_response(text, known).items()))


@query("run_batch_summary", "SELECT event_type AS method, count(*) AS runs, round(avg(value), 4) AS mean_seconds, round(sum(value), 2) AS total_seconds FROM events GROUP BY 1")
def run_batch_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("runs"), F.round(F.avg("value"), 4).alias("mean_seconds"), F.round(F.sum("value"), 2).alias("total_seconds"))
