"""Connected components of a link table, as a loop of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def components(links: DataFrame, a: str = "a", b: str = "b") -> Table:
    """Smallest id reachable from every id that has a link.

    links: pairs of ids in the columns a and b; nulls, repeated pairs and self-links are harmless.
    Returns a written table (id, component).  Alternates large-star and small-star steps: every
    node hands its neighbours to its smallest one, so the number of rounds grows with the logarithm
    of the size and a step never makes more rows than twice the links.  Each round is written to
    the shared folder, which cuts the lineage.  An empty link table gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    table = Table(edges)
    while True:
        both = table.df.unionByName(table.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = Table(large.where("u > v").distinct())
        low = step.df.groupBy("u").agg(F.min("v").alias("m"))
        small = step.df.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        after = Table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        step.drop()
        # A forest of stars: every u has one v, and no v is a u.
        same = after.df.groupBy("u").count().where("count > 1").limit(1).count() == 0 and after.df.join(after.df.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0
        table.drop()
        table = after
        if same:
            break
    pairs = table.df.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = Table(pairs.unionByName(pairs.select(F.col("component").alias("id"), "component").distinct()))
    table.drop()
    return out
