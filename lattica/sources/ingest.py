"""Readers, writers and record parsing: nested JSON, CSV, manifests, URLs and responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import EMOTIONS, SENTIMENTS, col
from ..operators.relational import numbered

ANNOTATION = "struct<template: string, template_original: string, pred_template: string, template_final: string, template_source: string, global_context_keywords: array<string>, local_context: struct<user_texts: array<string>, text_meaning: string>>"
# MIME types by file extension.
MIME_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}


def parse_annotations(lines: DataFrame, line: str = "value") -> DataFrame:
    """Flat rows of JSON lines {key, data: {...}}: blank and malformed lines and rows whose data is
    no object go; the key becomes a string; template_original falls back to template."""
    parsed = lines.where(F.trim(line) != "").select(F.get_json_object(line, "$.key").alias("key"), F.from_json(F.get_json_object(line, "$.data"), ANNOTATION).alias("data"), F.get_json_object(line, "$.data").alias("raw"))
    good = parsed.where(F.col("key").isNotNull() & F.ltrim("raw").startswith("{"))
    return good.select("key", F.coalesce("data.template_original", "data.template").alias("template_original"), "data.pred_template", "data.template_final", "data.template_source", F.array_join("data.global_context_keywords", " | ").alias("global_keywords"), F.array_join("data.local_context.user_texts", " ").alias("user_text"))


def read_nested_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_annotations(spark.read.text(path))


def affect_columns(sentiments: Column, emotions: Column, context: str) -> list[Column]:
    """Score columns from a map of sentiments and a list of {label, score}; unknown labels are
    dropped, and of repeated ones the last counts."""

    def last(label: str) -> Column:
        return F.aggregate(emotions, F.lit(None).cast("double"), lambda s, x: F.when(x["label"] == label, x["score"]).otherwise(s))

    return [last(k).alias(f"{k}_{context}") for k in EMOTIONS] + [F.element_at(sentiments, k).alias(f"{k}_{context}") for k in SENTIMENTS]


def parse_affect(lines: DataFrame, line: str = "value") -> DataFrame:
    maps, lists = "map<string, double>", "array<struct<label: string, score: double>>"
    schema = f"struct<key: string, global_sentiments: {maps}, local_sentiments: {maps}, global_emotions: {lists}, local_emotions: {lists}>"
    x = lines.select(F.from_json(line, schema).alias("r")).where("r.key is not null")
    return x.select("r.key", *affect_columns(F.col("r.global_sentiments"), F.col("r.global_emotions"), "global"), *affect_columns(F.col("r.local_sentiments"), F.col("r.local_emotions"), "local"))


def parse_keyed_json(documents: DataFrame, text: str = "value") -> DataFrame:
    """Rows of documents {key: {topic, probability}}."""
    m = F.from_json(text, "map<string, struct<topic: int, probability: double>>")
    return documents.select(F.explode(m).alias("key", "v")).select("key", "v.topic", "v.probability")


def parse_truncated_json(documents: DataFrame, text: str = "value") -> DataFrame:
    """The complete records of documents like those of parse_keyed_json that may be cut off."""
    record = r'"([^"]+)"\s*:\s*\{\s*"topic"\s*:\s*(-?\d+)\s*,\s*"probability"\s*:\s*([0-9.eE+-]+)\s*\}'
    parts = [F.regexp_extract_all(text, F.lit(record), i).alias(n) for i, n in enumerate(("key", "topic", "probability"), 1)]
    x = documents.select(F.explode(F.arrays_zip(*(p for p in parts))).alias("r"))
    names = x.schema["r"].dataType.names
    return x.select(F.col("r")[names[0]].alias("key"), F.col("r")[names[1]].cast("int").alias("topic"), F.col("r")[names[2]].cast("double").alias("probability"))


def file_order() -> Column:
    """Orders rows of a file source by file name, block and line."""
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))


def read_csv_typed(spark: SparkSession, path: str, columns: Sequence[str], name: str, encodings: Sequence[str] = ("UTF-8", "windows-1252", "ISO-8859-1")) -> DataFrame:
    """String columns of a CSV file: rows without a name go, the first row of a name stays, in the
    order of files and their lines; rows are numbered by name.

    The first encoding without replacement characters is taken.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = None
    for e in encodings:
        df = spark.read.csv(path, header=True, schema=schema, encoding=e, multiLine=True, escape='"')
        if not df.where(F.concat_ws("", *columns).contains("�")).limit(1).count():
            break
    df = df.select("*", file_order().alias("_at")).where(F.trim(name) != "")
    one = df.groupBy(name).agg(F.min_by(F.struct(*columns), "_at").alias("r")).select("r.*")
    return numbered(one, "row_id", name).withColumn("row_id", F.col("row_id").cast("int"))


def read_headerless_csv(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a two-column file; blank keys go, the first row of a key stays."""
    df = spark.read.csv(path, header=False, schema="key string, value string").select("*", file_order().alias("_at"))
    return df.where(F.trim("key") != "").groupBy("key").agg(F.min_by("value", "_at").alias("value"))


def scan_labelled_tree(spark: SparkSession, path: str, extensions: Sequence[str] = tuple(MIME_TYPES), max_labels: int | None = None, max_files: int | None = None) -> DataFrame:
    """Files below label folders as (image_path, template, source), without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split("path", "/")
    t = files.select(F.col("path").alias("image_path"), F.element_at(parts, -2).alias("template"), F.lit("tree").alias("source"))
    t = t.where(F.lower(F.element_at(F.split("image_path", r"\."), -1)).isin(*extensions))
    return capped(t, max_labels, max_files)


def capped(t: DataFrame, max_labels: int | None, max_files: int | None) -> DataFrame:
    if max_labels:
        t = t.withColumn("_l", F.dense_rank().over(W.orderBy("template"))).where(F.col("_l") <= max_labels).drop("_l")
    if max_files:
        t = t.withColumn("_f", F.row_number().over(W.partitionBy("template").orderBy("image_path"))).where(F.col("_f") <= max_files).drop("_f")
    return t


def normalise_manifest(df: DataFrame, source: str, old_prefix: str = "", new_prefix: str = "", max_labels: int | None = None, max_files: int | None = None) -> DataFrame:
    """A manifest in either layout as (image_path, template, source)."""
    if {"path", "template_name"} <= set(df.columns):
        df = df.withColumnsRenamed({"path": "image_path", "template_name": "template"})
    if not {"image_path", "template"} <= set(df.columns):
        raise ValueError(f"no manifest: {df.columns}")
    path = F.when(F.col("image_path").startswith(old_prefix), F.concat(F.lit(new_prefix), F.substr("image_path", F.lit(len(old_prefix) + 1)))).otherwise(F.col("image_path"))
    return capped(df.select(path.alias("image_path"), "template", F.lit(source).alias("source")), max_labels, max_files)


def provenance(data: DataFrame) -> DataFrame:
    """Final label and where it comes from: the prediction, else the original."""
    has = F.nullif(F.trim("pred_template"), F.lit("")).isNotNull()
    return data.withColumn("template_source", F.when(has, "prediction").when(F.col("template_original").isNotNull(), "original").otherwise("none")).withColumn("template_final", F.when(has, F.col("pred_template")).otherwise(F.col("template_original")))


def provenance_strict(data: DataFrame, none: str = "NO_TEMPLATE") -> DataFrame:
    """Final label and where it comes from, by the prediction alone: one that is missing or ``none``
    is no template."""
    label = F.coalesce("pred_template", F.lit(none))
    return data.withColumn("template_final", label).withColumn("template_source", F.when(label != none, "closed_set_assignment").otherwise("closed_set_no_template"))


def parse_response(c: Column | str, labels: Sequence[str], first_year: int = 1990, last_year: int = 2026) -> dict[str, Column]:
    """Fields of a model's answer: fences are stripped, the outermost object parsed, years outside
    the range dropped, and labels that are not known are invalid."""
    text = F.regexp_replace(col(c), r"```[a-zA-Z]*", "")
    r = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "struct<label: string, first_year: string>")
    year = F.try_to_number(F.regexp_extract(r["first_year"], r"^\s*(\d{1,4})\s*$", 1), F.lit("9999")).cast("int")
    inner = F.coalesce(F.get(F.from_json(r["label"], "array<string>"), 0), r["label"])
    return {"label": F.when(inner.isin(*labels), inner), "first_year": F.when(year.between(first_year, last_year), year), "valid": F.coalesce(inner.isin(*labels), F.lit(False))}


def request_manifest(df: DataFrame, prompt: str) -> DataFrame:
    """One JSON line a template: name, cluster, path, MIME type by extension, and prompt."""
    mime = F
    for e, t in MIME_TYPES.items():
        mime = mime.when(F.lower(F.col("path")).endswith(f".{e}"), t)
    return df.select(F.to_json(F.struct("template", "cluster", "path", mime.otherwise("application/octet-stream").alias("mime_type"), F.lit(prompt).alias("prompt"))).alias("value"))


def upsert_records(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Records (key, label, source) with the labels that changes have for their keys, and whether
    they were updated."""
    c = changes.select("key", F.col("label").alias("_new"))
    x = records.join(c, "key", "left")
    return x.select("key", F.coalesce("_new", "label").alias("label"), F.when(F.col("_new").isNotNull(), "prediction").otherwise(F.col("source")).alias("source"), F.col("_new").isNotNull().alias("updated"))


def missing_files(expected: DataFrame, found: DataFrame, key: str = "key") -> DataFrame:
    return expected.join(found, key, "left_anti")


def write_outputs(df: DataFrame, path: str, kind: str = "parquet") -> None:
    getattr(df.write.mode("overwrite"), kind)(path)


