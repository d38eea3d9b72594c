"""Exact deduplication that no group of copies can skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table

#: Parts that one digest's rows are dealt into, at least, and rows for which there is one more part.
SALTS, ROWS_A_SALT = 32, 1_000_000
#: Groups of more than one row in so many are broadcast by digest; there are no more than that.
OFTEN = 1000


def duplicate_groups(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """For every document, which of its equal texts stays.

    docs: doc_id long, text string (null counts as empty); other columns are ignored.  Texts are
    equal when identical.  Returns doc_id, keep_id (largest doc_id of the equal texts), group_size,
    kept, text_sha256 (hex digest of the text in UTF-8).

    Copies are combined three times, always by (digest, whole text): in each task, by the digest
    and a salt, and over the salts' winners, of which a group has ``salts`` at most (None: by the
    number of rows).  Rows then look up their group: by the digest where all rows of a digest
    were found to hold one text, by the whole text otherwise.  Groups of more than one row in OFTEN
    are broadcast, so that no group is one key of a shuffle, whatever its doc_ids.

    Null doc_id: counts in group_size and is not kept, unless no row of its text has an id; then
    keep_id is null and all are kept.  Repeated rows of one doc_id are the same document, so each
    gets the same answer.  Long texts are compared whole.  An empty table gives an empty result.
    """
    salts = salts or max(SALTS, docs.count() // ROWS_A_SALT)
    text = F.coalesce("text", F.lit(""))
    salt = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(salts)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"), salt.alias("salt"))
    return _labelled(rows, _labels(rows))


def _labels(rows: DataFrame) -> DataFrame:
    """keep_id and group_size of each digest; with the text where a digest has several."""
    local = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    # One exchange serves the groups and the count of a digest's texts.
    winners = local.repartition("digest").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = winners.withColumn("texts", F.count("*").over(W.partitionBy("digest")))
    text = F.when(F.col("texts") > 1, F.col("text")).alias("text")
    return Table(winners.select("digest", text, "keep_id", "group_size")).df


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    total = labels.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    alone = labels.where("text is null").drop("text")
    often = F.col("group_size") * OFTEN > total
    hot = F.broadcast(alone.where(often))  # fewer than OFTEN rows
    narrow = rows.select("doc_id", "digest")
    out = narrow.join(hot, "digest").unionByName(narrow.join(hot, "digest", "left_anti").join(alone.where(~often), "digest"))
    shared = labels.where("text is not null")
    if shared.limit(1).count():
        out = out.unionByName(rows.join(shared, ["digest", "text"]).drop("text", "salt"))
    kept = F.col("keep_id").isNull() | F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
