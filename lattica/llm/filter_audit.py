"""What each of several filters removes in every order of them, from path counts over the lattice of
the filters already applied."""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table

WHITE = "[\\x20\\x09-\\x0D]+"
COUNTS = ("n", "good", "toxic")


def paths(k: int) -> tuple[list[int], list[int]]:
    """Number of orders that reach each subset of k filters from the empty one, and that lead from it
    to the whole set; a state is a bit mask of the filters applied."""
    forward, backward = [0] * (1 << k), [0] * (1 << k)
    forward[0] = backward[-1] = 1
    for state in range(1 << k):
        for bit in range(k):
            if state >> bit & 1:
                forward[state] += forward[state ^ 1 << bit]
    for state in reversed(range(1 << k)):
        for bit in range(k):
            if not state >> bit & 1:
                backward[state] += backward[state | 1 << bit]
    return forward, backward


def lattice(names: str) -> list[tuple[int, str, int, int, int]]:
    """Edges (number, filter, state before, bit, orders that pass it) of the lattice of subsets."""
    forward, backward = paths(len(names))
    edges = [(state, i) for state in range(1 << len(names)) for i in range(len(names)) if not state >> i & 1]
    return [(e, names[i], state, 1 << i, forward[state] * backward[state | 1 << i]) for e, (state, i) in enumerate(edges)]


def _steps(spark: SparkSession, names: str) -> DataFrame:
    """The edge that each step of each order passes: k * k! rows, whatever the data."""
    edge = {(state, bit): e for e, _, state, bit, _ in lattice(names)}
    rows = []
    for order in itertools.permutations(range(len(names))):
        state = 0
        for step, i in enumerate(order, 1):
            rows.append(("".join(names[j] for j in order), step, edge[state, 1 << i]))
            state |= 1 << i
    return spark.createDataFrame(rows, "filter_order string, step int, edge int")


def audit(masks: DataFrame, names: str) -> DataFrame:
    """The audit of every part from its counts of documents by failure mask.

    masks: part, mask (bit i: fails the i-th filter of ``names``), and counts n, good, toxic; at most
    2**k rows a part.  Every mask is laid on all k * 2**(k - 1) edges of the lattice: an edge removes
    the documents that fail its filter and none of those applied before.  An edge's removals times
    the orders through it make up the filter's Shapley sum; a step of an order reads its edge.
    """
    edges = F.array(*(F.struct(F.lit(e).alias("edge"), F.lit(f).alias("filter"), F.lit(s).alias("state"), F.lit(b).alias("bit"), F.lit(w).cast("long").alias("orders")) for e, f, s, b, w in lattice(names)))
    laid = masks.select("part", "mask", *COUNTS, F.explode(edges).alias("e")).select("part", "mask", *COUNTS, "e.*")
    before, fails = F.col("mask").bitwiseAND(F.col("state")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(count: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(count)).otherwise(0)).cast("long")

    removed = ~before & fails
    passed = laid.groupBy("part", "edge", "filter", "orders").agg(
        total("n", ~before & ~fails).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", before & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
    )
    passed = Table(passed).df  # k * 2**(k - 1) rows a part
    shapley = passed.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).cast("long").alias("shapley"))
    steps = passed.join(F.broadcast(_steps(masks.sparkSession, names)), "edge").join(shapley, ["part", "filter"])
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Filters on one text: too short, too repetitive, too many capitals, signs."""
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, failures=text_failures, copies: str = "E") -> tuple[DataFrame, str]:
    """Documents by part and failure mask, with counts n, good and toxic, and the filters' names.

    ``failures`` gives the filters on a text and its words; the last filter, ``copies``, fails where
    the text is that of a smaller doc_id anywhere.  Texts leave the scan as digests: rows are
    combined by (document, text, part), then by (text, part) with the count of their smallest doc_id,
    so that a text of any number of copies is one row for each part.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = text.withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    filters: Mapping[str, Column] = failures(F.col("text"), F.col("words"))
    names = "".join(filters) + copies
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0)).cast("int")
    rows = split.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    # Rows without an id meet no label; they are dealt by their text.
    keyed = rows.withColumns({"own": F.col("doc_id").isNotNull(), "k": F.coalesce("doc_id", F.xxhash64("digest"))})
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("k")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    marked = keyed.join(marks.withColumn("own", F.lit(True)), ["k", "own"], "left")
    marked = marked.select("doc_id", "part", "mask", "digest", "n", *((F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in COUNTS[1:]))
    # Of each text in each part: all rows, those without an id, those of its smallest id.
    without = [F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"none_{c}") for c in COUNTS]
    own = F.min_by(F.struct(*COUNTS), "doc_id").alias("at_first")
    by_text = Table(marked.groupBy("digest", "part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS), *without, F.min("doc_id").alias("first"), own))
    first = by_text.df.where("first is not null").groupBy("digest").agg(F.min("first").alias("smallest"))
    x = by_text.df.join(first, "digest", "left")
    holds = F.col("first") == F.col("smallest")
    passes = [(F.col(f"none_{c}") + F.when(holds, F.col(f"at_first.{c}")).otherwise(0)).alias(f"pass_{c}") for c in COUNTS]
    x = x.select("part", "mask", *COUNTS, *passes)
    bit = 1 << len(filters)
    kinds = F.array(F.struct(F.col("mask").alias("mask"), *(F.col(f"pass_{c}").alias(c) for c in COUNTS)), F.struct((F.col("mask") + bit).alias("mask"), *((F.col(c) - F.col(f"pass_{c}")).alias(c) for c in COUNTS)))
    counted = x.select("part", F.explode(kinds).alias("x")).select("part", "x.*").groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS))
    counted = Table(counted).df
    by_text.drop()
    return counted, names


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Five filters in all 120 orders, by source.

    docs: doc_id long, text string, source string; labels: doc_id, quality, toxic; other columns are
    ignored.  Failure conditions: A under 50 words; B 100 * distinct words < 65 * words; C
    100 * [A-Z] > 5 * code points; D any of #$%&*|; E the text of a smaller doc_id.  Returns per part,
    order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty, a null source the part with the empty name.  A null doc_id is neither
    smaller nor larger than others: such a row never fails E, makes none fail, and has no label.
    Rows that repeat a doc_id count each; equal ids do not make each other copies.  A document with
    several labels is good or toxic if one says so; a null label says neither.  Texts of any length
    are looked at whole, within their row.  Without documents there is no row.
    """
    return audit(*failure_masks(docs, labels))
