"""Agglomerative clustering by reciprocal nearest neighbours, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import checkpointed


def _average(s: Column, na: Column, nb: Column, wa: Column, wb: Column) -> Column:
    """Mean of the pairs' values."""
    return s / (na * nb)


def _ward(s: Column, na: Column, nb: Column, wa: Column, wb: Column) -> Column:
    """What joining adds to the squares within clusters, from sums of squared distances of pairs."""
    between = s / (na * nb) - wa / (na * na) - wb / (nb * nb)
    return F.greatest(between, F.lit(0.0)) * na * nb / (na + nb)


LINKAGES = {"average": _average, "ward": _ward}


def merges(ids: DataFrame, pairs: DataFrame, linkage: str, most: float | None = None) -> DataFrame:
    """The joins of a dendrogram, (a, b, height): b goes into a, the smaller id; heights up to ``most``.

    ids: id; pairs: a, b, value - the distance of the pair (``average``) or its square (``ward``).  A pair
    that is missing has no value, so its clusters are never joined directly; give all pairs of what
    may come together.

    All clusters that are each other's nearest are joined at once (of equal ones, that of the smaller
    id), which for these linkages gives the joins that one at a time would.  Linkages need only
    sums over pairs of members, so a round relabels the pairs and adds them up.
    """
    measure = LINKAGES[linkage]

    def measured(links: DataFrame, nodes: DataFrame) -> DataFrame:
        """The links with their height, null where pairs of their members are missing."""
        ends = [nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("w").alias(f"w{x}")) for x in "ab"]
        at = links.join(ends[0], "a").join(ends[1], "b")
        height = F.when(F.col("k") == F.col("na") * F.col("nb"), measure(*map(F.col, ("s", "na", "nb", "wa", "wb"))))
        return checkpointed(at.select("a", "b", "s", "k", height.alias("height")))

    nodes = checkpointed(ids.select("id", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("w")))
    links = measured(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("value").cast("double").alias("s"), F.lit(1).cast("long").alias("k")), nodes)
    out = None
    while True:
        at = links.where("height is not null" if most is None else F.col("height") <= most)
        sides = at.select("a", F.struct("height", "b").alias("x")).unionByName(at.select(F.col("b").alias("a"), F.struct("height", F.col("a").alias("b")).alias("x")))
        best = sides.groupBy("a").agg(F.min("x").alias("x")).select("a", "x.b", "x.height")
        back = best.select(F.col("b").alias("a"), F.col("a").alias("b"))
        joined = checkpointed(best.join(back, ["a", "b"]).where("a < b").join(at.select("a", "b", "s"), ["a", "b"]).select("a", "b", "height", "s"))
        if not joined.limit(1).count():
            return out if out is not None else joined.select("a", "b", "height")
        step = joined.select("a", "b", "height")
        out = step if out is None else out.unionByName(step)
        into = joined.select(F.col("b").alias("id"), F.col("a").alias("to"))
        inner = joined.select(F.col("a").alias("id"), "s")
        moved = nodes.join(into, "id", "left").select(F.coalesce("to", "id").alias("id"), "n", "w").groupBy("id").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        nodes = checkpointed(moved.join(inner, "id", "left").select("id", "n", (F.col("w") + F.coalesce("s", F.lit(0.0))).alias("w")))
        ends = links.drop("height")
        for x in "ab":
            ends = ends.join(into.select(F.col("id").alias(x), "to"), x, "left").withColumn(x, F.coalesce("to", x)).drop("to")
        links = measured(ends.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"), F.sum("k").alias("k")), nodes)


def cut(ids: DataFrame, joins: DataFrame, clusters: int | None = None) -> DataFrame:
    """(id, cluster): the smallest id of the cluster that the joins make, or those of the lowest heights that
    leave ``clusters``."""
    from .cluster import components

    if clusters is not None:
        n = ids.count()
        joins = joins.withColumn("r", F.row_number().over(W.orderBy("height", "a", "b"))).where(F.col("r") <= max(n - clusters, 0))  # one row a join of entities
    return components(ids.select("id"), joins.select("a", "b")).withColumnRenamed("component", "cluster")


def ward_clusters(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Rows with a ``cluster`` from 0 to k - 1, by the smallest key, of Ward's method on vectors; for entity
    tables, as all pairs of rows are made.  Rows of a null vector have a null cluster."""
    from .relational import numbered

    known = rows.where(F.col(vector).isNotNull()).select(key, vector)
    ids = checkpointed(numbered(known, "id", key))
    a, b = (ids.select(F.col("id").alias(x), F.col(vector).alias(f"v{x}")) for x in "ab")
    square = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = a.join(b, F.col("a") < F.col("b")).select("a", "b", square.alias("value"))
    found = cut(ids, merges(ids, pairs, "ward"), k)
    names = found.groupBy("cluster").agg(F.min("id").alias("first")).select("cluster", (F.row_number().over(W.orderBy("first")) - 1).alias("number"))  # k rows
    labelled = ids.join(found, "id").join(F.broadcast(names), "cluster").select(key, F.col("number").alias("cluster"))
    return rows.join(labelled, key, "left")


def pairs_of_components(ids: DataFrame, near: DataFrame) -> DataFrame:
    """All pairs (a, b) within each component of the near pairs (a, b): variants of one name, as a rule few.
    Clusters whose mean distance is within a bound have a pair within it, so that average linkage up
    to the bound needs no other pairs than these."""
    from .cluster import components

    c = checkpointed(components(ids.select("id"), near).where("id is not null"))
    linked = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    c = c.join(linked, "id", "left_semi")
    return c.select("component", F.col("id").alias("a")).join(c.select("component", F.col("id").alias("b")), "component").where("a < b").select("a", "b")
