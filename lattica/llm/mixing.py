"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table

WEIGHTS = (5.0, 2.0, 1.0)
#: Slots of the schedule while blocks have at most MAX_BLOCK words; beyond, slots grow with the input.
SLOTS, MAX_BLOCK = 131_072, 4096
#: Documents of a source that are ordered in one task, about.
ORDERED_TOGETHER = 2048
#: Sources up to this number are broadcast.
FEW_SOURCES = 10_000
GOLDEN = 0.6180339887498949


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Targets of sources from their sizes: source, rows, source_size, number, weight, target.

    Sources in code point order, null last, have the weights in turn.  Together they get ``share``
    of all words, by weight; a target stops at ``limit`` times its source and the excess is shared
    again.  That is the water level: with the sources by rising limit per weight, the level is what
    is left after the first i are full, over the weight of the others.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("number", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(limit))
    rising = W.orderBy(F.col("full") / F.col("weight"), "number")
    everything = W.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(share)
    before = F.coalesce(F.sum("full").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing))
    s = s.withColumn("level", (budget - before) / after)
    open_ = F.when(F.col("full") / F.col("weight") >= F.col("level"), F.col("level"))
    first = F.min(F.when(open_.isNotNull(), F.struct((F.col("full") / F.col("weight")).alias("ratio"), "number", "level"))).over(everything)
    target = F.least(F.col("full"), F.coalesce(first["level"], F.lit(float("inf"))) * F.col("weight"))
    return s.select("source", "rows", "source_size", "number", target.alias("target"))


def _placed(docs: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Narrow rows of the documents with size, source_size, target, taken and order, a hash."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"), F.xxhash64("doc_id", "text").alias("order"))
    rows = Table(rows).df  # texts are read once
    sizes = Table(rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")))
    sources = Table(source_targets(sizes.df, weights, share, limit))
    n_sources, words = sources.df.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    few = n_sources <= FEW_SOURCES
    block = max(1, min(MAX_BLOCK, int(words) // SLOTS))

    # The stream: documents by salted order, then the parts' offsets.
    s = F.broadcast(sources.df) if few else sources.df
    docs_of = rows.alias("r").join(s.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.doc_id", "r.size", "r.order", "s.number", "s.rows", "s.source_size", "s.target")
    docs_of = docs_of.withColumn("part", F.pmod(F.xxhash64("order"), 1 + F.floor(F.col("rows") / ORDERED_TOGETHER)))
    parts = docs_of.groupBy("number", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.select("number", "part", (F.sum("part_size").over(W.partitionBy("number").orderBy("part")) - F.col("part_size")).alias("before"))
    within = F.sum("size").over(W.partitionBy("number", "part").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    placed = docs_of.withColumn("within", within).join(parts, ["number", "part"]).withColumn("start", F.col("before") + F.col("within"))
    placed = Table(placed.select("doc_id", "size", "order", "number", "source_size", "target", "start")).df

    # Slots take blocks of the stream, which holds every document once a lap.
    slots = schedule(sources.df, block, int(words) // block + 1, few)
    spans = placed.where("size > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(limit) - 1))))
    spans = spans.withColumn("from", F.col("start") + F.col("lap") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))
    spans = spans.where(F.col("from") < F.round("target"))
    covered = spans.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    hit = covered.join(slots, ["number", "rank"])
    end = F.least(F.col("to"), (F.col("rank") + 1) * block, F.round("target").cast("long"))
    words_in = F.greatest(end - F.greatest(F.col("from"), F.col("rank") * block), F.lit(0))
    taken = hit.groupBy("number", "start").agg(F.sum(words_in).cast("long").alias("taken"))
    # Texts without words share their start with each other; nothing is taken of them.
    out = placed.where("size > 0").join(taken, ["number", "start"], "left")
    out = out.unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "order")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id long, text, source string; other columns are ignored.  Returns doc_id, size
    (words), source_size, target (of its source), taken (words the mix takes, repeats counted).

    A source's documents, shuffled by hash, form a stream of words, laid out twice; the stream is
    cut into blocks of equal length.  Slot k of the schedule is the point frac(k * golden ratio) on
    the cumulative targets, so every stretch of the schedule holds the sources at their weights;
    the r-th slot of a source takes the r-th block of its stream, the last one cut to the target.
    Where a source has a few slots less than its target needs, they follow at the end.

    Null text and texts without words: size 0, nothing is taken.  The words of long texts are all
    counted; a document longer than a block is taken block by block.  A source of most rows is many
    parts, by its documents' hashes; only rows that repeat both doc_id and text share a part.  Null source is a source of its
    own, last in order.  Null doc_ids and repeated rows are documents like others.  An empty table
    gives an empty result.  Reruns agree, as the order is by hash.
    """
    return _placed(docs, weights, share, limit).drop("order")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The mix as whole documents with their columns, each as often as its taken words make it.

    The number of times is rounded; only a source's last document in the stream is taken in part.
    """
    placed = _placed(docs, weights, share, limit).where("size > 0")
    times = placed.select("order", F.row_number().over(W.partitionBy("order").orderBy("doc_id", F.desc("taken"))).alias("n"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("order"))
    own = own.withColumn("n", F.row_number().over(W.partitionBy("order").orderBy("row.doc_id")))
    chosen = own.join(times.where("times > 0"), ["order", "n"])
    return chosen.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


def schedule(sources: DataFrame, block: int, n: int, few: bool = True) -> DataFrame:
    """Slots as (number of the source, rank in it): n golden-ratio points, and those still missing.

    Points are ranked in parts of the schedule, so a source with most of the slots is many tasks.
    """
    spark = sources.sparkSession
    cumulative = W.orderBy("number")
    bounds = sources.where("target > 0").select("number", F.ceil(F.round("target") / block).alias("slots"), F.sum("target").over(cumulative).alias("hi"), F.sum("target").over(W.partitionBy()).alias("all"))
    bounds = bounds.select("number", "slots", (F.lag("hi", 1, 0.0).over(cumulative) / F.col("all")).alias("lo"), F.when(F.lead("hi").over(cumulative).isNull(), 2.0).otherwise(F.col("hi") / F.col("all")).alias("hi"))
    bounds = Table(bounds).df
    x = F.col("slot") * F.lit(GOLDEN)
    points = spark.range(n).select(F.col("id").alias("slot")).withColumn("x", x - F.floor(x))
    # A point's source: cells of the unit interval name the sources that reach into them.
    cells = 4096
    reach = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    points = points.withColumn("cell", F.least(F.floor(F.col("x") * cells), F.lit(cells - 1)))
    owned = points.join(F.broadcast(reach) if few else reach, "cell").where("x >= lo and x < hi").select("slot", "number", "slots")
    owned = owned.withColumn("part", F.floor(F.col("slot") / ORDERED_TOGETHER))
    parts = owned.groupBy("number", "part").agg(F.count("*").alias("n"))
    parts = parts.select("number", "part", (F.sum("n").over(W.partitionBy("number").orderBy("part")) - F.col("n")).alias("before"))
    ranked = owned.withColumn("within", F.row_number().over(W.partitionBy("number", "part").orderBy("slot")) - 1).join(parts, ["number", "part"])
    ranked = ranked.select("number", (F.col("before") + F.col("within")).alias("rank"), "slots").where("rank < slots").select("number", "rank")
    have = owned.groupBy("number").agg(F.count("*").alias("n"))
    missing = bounds.join(have, "number", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < slots")
    missing = missing.select("number", F.explode(F.sequence(F.col("n"), F.col("slots") - 1)).alias("rank"))
    return ranked.unionByName(missing)
