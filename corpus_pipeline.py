"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import Table
from lattica.llm.exact_dedup import duplicate_groups
from lattica.llm.mixing import mixed_documents
from lattica.llm.ngram_join import ngram_components
from lattica.llm.packing import pack_documents
from lattica.llm.quality import accepted
from lattica.llm.queries import word_tokenizer

# Every stage reads whole texts of any length, takes tables with more columns than it needs, and
# gives no row for an empty table.


def _id(doc_id: Column) -> Column:
    """doc_id for joins in which rows without one meet too."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)).cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null text is judged as an empty one; a null doc_id and repeated rows are judged like others.
    """
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id.

    Null counts as empty.  Of rows that repeat a doc_id and its text one stays, also of those without
    a doc_id where no row of their text has one.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    keep = duplicate_groups(docs).where("kept").select(_id(F.col("doc_id")).alias("_id"), F.col("text_sha256").alias("_digest")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _id(F.col("doc_id")).alias("_id"), digest.alias("_digest"))
    same = W.partitionBy("_id", "_digest").orderBy("_id")
    rows = rows.join(keep, ["_id", "_digest"], "left_semi").withColumn("_n", F.row_number().over(same))
    return rows.where("_n = 1").select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity, that with the smallest doc_id.

    Texts without words are linked with nothing and stay, as do rows without a doc_id; rows that
    repeat a doc_id stay or go together.
    """
    out = ngram_components(docs).where("doc_id is null or doc_id = component_id").select(_id(F.col("doc_id")).alias("_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _id(F.col("doc_id")).alias("_id"))
    return rows.join(out, "_id", "left_semi").select("_row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, twice at most.

    Texts without words have nothing to take and go; a null source is a source of its own.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens; repeated rows and null
    doc_ids are documents like others."""
    return pack_documents(docs, word_tokenizer())


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packing", packing),
]

#: The classifier, the mix and the packing have no SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
