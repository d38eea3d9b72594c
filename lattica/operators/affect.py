"""Paired affect labels: transitions between contexts and measures of information."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import dominant
from .ordered import with_medians

EPSILON = 1e-12


def dominant_pairs(rows: DataFrame, first: dict[str, str], second: dict[str, str], keep: Sequence[str] = ("key",)) -> DataFrame:
    """Dominant labels and scores of two contexts."""
    (g, gs), (l, ls) = dominant(first), dominant(second)
    return rows.select(*keep, g.alias("global_label"), gs.alias("global_score"), l.alias("local_label"), ls.alias("local_score"))


def label_grid(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """All pairs of a fixed list of labels."""
    one = df.sparkSession.createDataFrame([(x,) for x in labels], "l string")
    return one.select(F.col("l").alias("global_label")).crossJoin(F.broadcast(one.select(F.col("l").alias("local_label"))))


def transition_counts(pairs: DataFrame, labels: Sequence[str], threshold: float) -> DataFrame:
    """Counts of (global_label, local_label) on the whole grid, both scores at least the threshold,
    and the share of each in its row (null in an empty row)."""
    n = pairs.where((F.col("global_score") >= threshold) & (F.col("local_score") >= threshold)).groupBy("global_label", "local_label").agg(F.count("*").alias("n"))
    grid = label_grid(pairs, labels).join(F.broadcast(n), ["global_label", "local_label"], "left")  # as many rows as label pairs
    grid = grid.withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.withColumn("p", F.col("n") / F.nullif(F.sum("n").over(W.partitionBy("global_label")), F.lit(0)))


def threshold_cooccurrence(rows: DataFrame, first: dict[str, str], second: dict[str, str], labels: Sequence[str], threshold: float) -> DataFrame:
    """For every pair of labels the rows in which both scores reach the threshold."""
    aggs = [F.count_if((F.col(first[a]) >= threshold) & (F.col(second[b]) >= threshold)).alias(f"{a}|{b}") for a in labels for b in labels]
    wide = rows.agg(*aggs)
    pairs = F.explode(F.array(*(F.struct(F.lit(c.split("|")[0]).alias("global_label"), F.lit(c.split("|")[1]).alias("local_label"), F.col(c).alias("n")) for c in wide.columns))).alias("x")
    return wide.select(pairs).select("x.*")


def _rows(counts: DataFrame) -> W:
    return W.partitionBy("global_label")


def alignment(counts: DataFrame) -> DataFrame:
    """Diagonal share of every global label and of all of them (OVERALL)."""
    by = counts.groupBy("global_label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("global_label") == F.col("local_label"), F.col("n")).otherwise(0)).alias("aligned"))
    every = by.agg(F.lit("OVERALL").alias("global_label"), F.sum("n").alias("n"), F.sum("aligned").alias("aligned"))
    return by.unionByName(every).withColumn("rate", F.col("aligned") / F.nullif(F.col("n"), F.lit(0)))


def neutral_injection(counts: DataFrame, neutral: str = "neutral") -> DataFrame:
    """Where posts with a neutral global context go."""
    return counts.where(F.col("global_label") == neutral).select("local_label", "n", "p")


def incongruity(counts: DataFrame) -> DataFrame:
    return counts.where((F.col("global_label") != F.col("local_label")) & (F.col("n") > 0)).select("global_label", "local_label", "n", F.row_number().over(W.orderBy(F.desc("n"), "global_label", "local_label")).alias("rank"))


def transition_share(counts: DataFrame, neutral: str = "neutral") -> DataFrame:
    kind = F.when(F.col("global_label") == F.col("local_label"), "aligned").when(F.col("local_label") == neutral, "muted").otherwise("transformed")
    n = counts.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"))
    return n.withColumn("share", F.col("n") / F.nullif(F.sum("n").over(W.partitionBy()), F.lit(0)))


def plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def conditional_entropy(counts: DataFrame) -> DataFrame:
    """Entropy in bits of each row's shares, and over the logarithm of the number of labels."""
    return counts.groupBy("global_label").agg(F.sum("n").alias("n"), (-F.sum(plogp(F.col("p")))).alias("entropy"), F.count("*").alias("k")).select("global_label", "n", "entropy", (F.col("entropy") / F.log2("k")).alias("entropy_norm"))


def kl_to_marginal(counts: DataFrame) -> DataFrame:
    """Divergence of each row from the local labels' distribution, every cell smoothed before both are scaled to 1."""
    marginal, total = F.sum("n").over(W.partitionBy("local_label")), F.sum("n").over(W.partitionBy())
    c = counts.withColumn("q", marginal / F.nullif(total, F.lit(0))).withColumn("a", F.coalesce("p", F.lit(0.0)) + EPSILON).withColumn("b", F.coalesce("q", F.lit(0.0)) + EPSILON)
    c = c.withColumn("a", F.col("a") / F.sum("a").over(_rows(c))).withColumn("b", F.col("b") / F.sum("b").over(_rows(c)))
    return c.groupBy("global_label").agg(F.sum(F.col("a") * F.log2(F.col("a") / F.col("b"))).alias("kl"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """Mutual information in bits, over the smaller entropy, both entropies and H(local | global)."""
    total = F.sum("n").over(W.partitionBy())
    c = counts.select("global_label", "local_label", (F.col("n") / total).alias("pxy"), (F.sum("n").over(_rows(counts)) / total).alias("px"), (F.sum("n").over(W.partitionBy("local_label")) / total).alias("py"), F.count("*").over(_rows(counts)).alias("k"))
    m = c.agg(
        F.sum(F.when(F.col("pxy") > 0, F.col("pxy") * F.log2(F.col("pxy") / (F.col("px") * F.col("py")))).otherwise(0.0)).alias("mutual_information"),
        (-F.sum(plogp(F.col("px")) / F.col("k"))).alias("entropy_global"),
        (-F.sum(plogp(F.col("py")) / F.col("k"))).alias("entropy_local"),
    )
    return m.select("*", (F.col("mutual_information") / F.nullif(F.least("entropy_global", "entropy_local"), F.lit(0.0))).alias("nmi"), (F.col("entropy_local") - F.col("mutual_information")).alias("entropy_local_given_global"))


def dominant_summary(pairs: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    kept = pairs.where(F.col(score) >= threshold).select(F.col(label).alias("label"), F.col(score).alias("score"))
    s = kept.groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    s = with_medians(s, kept, ["label"], ["score"])
    return s.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def score_histogram(df: DataFrame, score: str, bins: int) -> DataFrame:
    """Counts in equal bins between the smallest and the largest score; the last one is closed."""
    span = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    b = df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(span))  # one row
    b = b.withColumn("bin", F.least(F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    n = b.groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_smooth(histogram: DataFrame, kernel: Sequence[int] = (1, 2, 3, 2, 1)) -> DataFrame:
    """Counts by a kernel around each bin, over the kernel's sum; bins beyond the ends count 0."""
    w = W.orderBy("bin")  # one row a bin
    half = len(kernel) // 2
    total = F.lit(0.0)
    for i, k in enumerate(kernel):
        o = i - half
        total = total + k * (F.lag("n", -o, 0).over(w) if o < 0 else F.lead("n", o, 0).over(w) if o else F.col("n"))
    return histogram.withColumn("smooth", total / float(sum(kernel)))


def jensen_shannon(rows: DataFrame, group: str, category: str, value: str, base: float, within: str | None = None) -> DataFrame:
    """Distance (square root) between every two groups' distributions over the union of categories;
    with ``within``, only between groups of one value of that column, which goes with the groups.

    A category of one group of a pair adds its share times ln 2 / 2, so all of those together follow
    from the shares of the common ones: only categories that two groups share are joined, and
    the pairs themselves are the result.  Null groups and categories, and groups whose values add
    up to nothing, take no part.
    """
    own = [within] if within else []
    p = rows.where(F.col(group).isNotNull() & F.col(category).isNotNull()).groupBy(*own, group, category).agg(F.sum(value).alias("v"))
    totals = p.groupBy(*own, group).agg(F.sum("v").alias("total")).where("total > 0")  # one row a group
    p = p.where("v > 0").join(totals, [*own, group]).select(*own, group, category, (F.col("v") / F.col("total")).alias("p"))
    left, right = (p.select(*own, category, F.col(group).alias(g), F.col("p").alias(f"p{g}")) for g in "ab")
    pa, pb = F.col("pa"), F.col("pb")
    both = pa * F.log(pa / (pa + pb)) + pb * F.log(pb / (pa + pb))
    common = left.join(right, [*own, category]).where("a < b").groupBy(*own, "a", "b").agg(F.sum(both).alias("both"))
    names = [totals.select(*own, F.col(group).alias(g)) for g in "ab"]
    pairs = (names[0].join(names[1], own) if own else names[0].crossJoin(names[1])).where("a < b")
    # p ln(p / m) is p ln(p / (pa + pb)) + p ln 2, and the shares of both groups add up to 2.
    js = F.coalesce("both", F.lit(0.0)) / 2 + math.log(2)
    out = pairs.join(common, [*own, "a", "b"], "left")
    return out.select(*own, "a", "b", F.sqrt(F.greatest(js / F.log(F.lit(base)), F.lit(0.0))).alias("distance"))
