"""Fuzzy matches of names: exact top-k over all pairs without making them, containment, and spelling
variants.

A pair's score is bounded by what the two names share: words, characters, and their lengths.  Each query
first gets a few candidates, whose k-th score says how much a better one must share with it; it then asks
only for its rarest words and characters, of which such a candidate must have one.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .relational import checkpointed

#: Longest strings by which contained names are found.
GRAM = 3
_EPS = 1e-6


def words(name: Column | str) -> Column:
    return F.array_distinct(F.split(name, " "))


def characters(name: Column | str) -> Column:
    """Characters with the number of their occurrence, so that common ones count as often as both have
    them."""
    c = F.array_sort(F.split(name, ""))
    return F.transform(F.array_remove(c, ""), lambda x, i: F.concat(x, (i - F.array_position(F.array_remove(c, ""), x)).cast("string")))


def substrings(name: Column, n: int) -> Column:
    """Distinct strings of n characters."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(n)))
    return F.when(F.length(name) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def token_scores(query: Column, candidate: Column) -> tuple[Column, Column]:
    """Jaccard similarity of the words, and the share of the longer name that a contained one is."""
    a, b = words(query), words(candidate)
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    contains = F.contains(candidate, query) | F.contains(query, candidate)
    longer = F.nullif(F.greatest(F.length(query), F.length(candidate)), F.lit(0))
    return jaccard, F.when(contains, F.coalesce(F.least(F.length(query), F.length(candidate)) / longer, F.lit(1.0))).otherwise(0.0)


def _placed(names: DataFrame, name: str, tokens: Column, counts: DataFrame) -> DataFrame:
    """name, t, n (tokens of the name), df, place (from 1, rarest first) and before (names met by those
    rarer) for every token of every name; one window a name."""
    long = names.select(name, F.size(tokens).alias("n"), F.explode(tokens).alias("t")).join(counts, "t", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    w = W.partitionBy(name).orderBy("df", "t")
    return long.withColumn("place", F.row_number().over(w)).withColumn("before", F.sum("df").over(w) - F.col("df"))


def _counts(long: DataFrame) -> DataFrame:
    return long.groupBy("t").agg(F.count("*").alias("df"))


def _rarest(names: DataFrame, name: str, keep: list[str], counts: DataFrame) -> DataFrame:
    """keep and the rarest string of each name (of GRAM characters, or of all of a shorter one)."""
    grams = F.array_distinct(F.flatten(F.array(*(F.when(F.least(F.length(name), F.lit(GRAM)) == n, substrings(F.col(name), n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)))))
    long = names.select(*keep, F.explode(grams).alias("t")).join(counts, "t", "left")
    return long.groupBy(*keep).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t")).alias("m")).select(*keep, "m.t")


def contained(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Pairs (query, row_id, name) in which one name is within the other: the k of each query whose lengths
    are the closest, ties by the larger row_id.  The longer name has all strings of the shorter, so
    they meet by the rarest one of the shorter; tasks keep k a query before the shuffle."""
    grams = F.flatten(F.array(*(substrings(F.col("name"), n) for n in range(1, GRAM + 1))))
    held = candidates.where("name <> ''").select("row_id", "name", F.explode(grams).alias("t"))
    counts = checkpointed(_counts(held))
    inside = _rarest(queries.where("query <> ''"), "query", ["query"], counts).join(held, "t").where(F.contains("name", "query"))
    own = queries.where("query <> ''").select("query", F.explode(F.flatten(F.array(*(substrings(F.col("query"), n) for n in range(1, GRAM + 1))))).alias("t"))
    around = _rarest(candidates.where("name <> ''"), "name", ["row_id", "name"], counts).join(own, "t").where(F.contains("query", "name"))
    pairs = inside.select("query", "row_id", "name").unionByName(around.select("query", "row_id", "name"))
    share = F.round(token_scores(F.col("query"), F.col("name"))[1] * 100, 4)
    # A pair may come from both sides where the names are equal, hence two k.
    w = W.partitionBy("query").orderBy(share.desc(), F.desc("row_id"))
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * k).drop("r")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _scored(pairs: DataFrame, with_sequence: bool) -> DataFrame:
    score = F.greatest(*token_scores(F.col("query"), F.col("name")))
    if with_sequence:
        score = F.greatest(score, sequence_ratio("query", "name"))
    return pairs.distinct().withColumn("score", F.round(score * 100, 4))


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.desc("row_id")))).where(F.col("rank") <= k)


def fuzzy_match_topk(queries: DataFrame, candidates: DataFrame, k: int, with_sequence: bool = False) -> DataFrame:
    """The k best candidates (row_id, name) of every query (name) among all: the largest of the token
    scores, and with ``with_sequence`` the sequence ratio, times 100; ties go to the larger row_id.
    Returns query, row_id, name, score, rank.

    A query's first candidates share its rarest words, contain it or are contained in it.  With t its
    k-th score among them, a better one by words has t of them, so one of the n - t n + 1 rarest; a better
    one by sequence has t (a + b) / 2 of its characters, so one of the rarest likewise, and a
    length that allows t; pairs whose common characters do not reach t are not aligned.  Candidates of
    the largest row_ids stand in where nothing is shared.

    Names may repeat; a query is answered once.  Null names and row_ids take no part; empty names
    equal each other.  A query with fewer than k candidates gets all there are.
    """
    q = checkpointed(queries.where("name is not null").select(F.col("name").alias("query")).distinct())
    c = checkpointed(candidates.where("name is not null and row_id is not null").select("row_id", "name").distinct())
    held = c.select("row_id", "name", F.explode(words("name")).alias("t"))
    own = checkpointed(_placed(q, "query", words("query"), _counts(held)))
    last = F.broadcast(c.orderBy(F.desc("row_id")).limit(2 * k))
    first = own.where((F.col("before") < 2 * k) & (F.col("df") > 0)).join(held, "t").select("query", "row_id", "name")
    first = checkpointed(first.unionByName(contained(q, c, k)).unionByName(q.crossJoin(last)).distinct())  # 2 k rows a query
    top = checkpointed(_ranked(_scored(first, with_sequence), k))
    least = top.groupBy("query").agg(F.count("*").alias("have"), F.min("score").alias("kth"))
    least = checkpointed(least.select("query", F.when(F.col("have") == k, F.greatest(F.col("kth") / 100 - _EPS, F.lit(0.0))).otherwise(0.0).alias("least")))
    asked = own.join(least, "query").where((F.col("df") > 0) & (F.col("place") <= F.col("n") - F.ceil(F.col("least") * F.col("n") - _EPS) + 1))
    more = asked.join(held, "t").select("query", "row_id", "name")
    if with_sequence:
        signs = c.select("row_id", "name", F.length("name").alias("b"), F.explode(characters("name")).alias("t"))
        placed = _placed(q, "query", characters("query"), _counts(signs)).join(least, "query")
        # n characters of a query share at least t (n + n t / (2 - t)) / 2 with any name long enough for t.
        need = F.ceil(F.col("least") * F.col("n") / (2 - F.col("least")) - _EPS)
        met = placed.where((F.col("df") > 0) & (F.col("place") <= F.col("n") - need + 1)).join(signs, "t")
        met = met.where(2 * F.least("n", "b") / (F.col("n") + F.col("b")) >= F.col("least") - _EPS).select("query", "row_id", "name", "n", "b", "least").distinct()
        common = F.size(F.array_intersect(characters("query"), characters("name")))
        more = more.unionByName(met.where(2 * common / (F.col("n") + F.col("b")) >= F.col("least") - _EPS).select("query", "row_id", "name"))
    rest = more.distinct().join(top.select("query", "row_id", "name"), ["query", "row_id", "name"], "left_anti")
    return _ranked(top.drop("rank").unionByName(_scored(rest, with_sequence)), k)


def containing_name(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, found): the first candidate (name) that has the words of a name in a row, where there is
    one.  Such a candidate has the name's rarest word, by which they meet."""
    held = candidates.select(F.col("name").alias("image"), F.explode(words("name")).alias("t"))
    own = _placed(names.select(F.col("name").alias("query")).distinct(), "query", words("query"), _counts(held)).where("place = 1")
    pad = F.lit(" ")
    met = own.join(held, "t").where(F.contains(F.concat(pad, "image", pad), F.concat(pad, "query", pad)))
    return met.groupBy(F.col("query").alias("name")).agg(F.min("image").alias("found"))


def cosine_pairs(names: DataFrame, least: float, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, cosine), a < b, of the (id, name) rows whose sets of words have that cosine at least;
    or of the given pairs (a, b), whatever theirs is.

    Sets of such a cosine share least ** 2 of the words of either, so they meet by the words that are the
    rarest but for as many: of two names that share enough, both have one such word in common.
    """
    floor = least - 1e-12 if pairs is None else -1.0
    sets = checkpointed(names.select("id", words("name").alias("w")))
    long = sets.select("id", F.size("w").alias("n"), F.explode("w").alias("t"))
    if pairs is None:
        counts = _counts(long)
        w = W.partitionBy("id").orderBy("df", "t")
        rare = long.join(counts, "t").withColumn("place", F.row_number().over(w))
        rare = checkpointed(rare.where(F.col("place") <= F.col("n") - F.ceil(least * least * F.col("n") - _EPS) + 1).select("id", "n", "t"))
        sides = [rare.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), "t") for x in "ab"]
        near = F.least("na", "nb") >= least * least * F.greatest("na", "nb") - _EPS
        pairs = sides[0].join(sides[1], "t").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    named = [sets.select(F.col("id").alias(x), F.col("w").alias(f"w{x}")) for x in "ab"]
    both = pairs.select("a", "b").join(named[0], "a").join(named[1], "b")
    cosine = F.size(F.array_intersect("wa", "wb")) / F.sqrt(F.size("wa").cast("double") * F.size("wb"))
    return both.select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= floor)
