"""Joins, de-duplication, sampling and summaries that do not depend on the domain."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import CLASS_ORDER


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder that the session names, so that their lineage ends."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows numbered from 1 in an order that tells them apart, by range partitions and their offsets.

    The ranged rows are written, so that both readers see the same partitions."""
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_w", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_w")).drop("_part", "_w", "_before")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, or an error as soon as a key is seen twice."""
    n = F.count("*").over(W.partitionBy(*keys))
    return df.withColumn("_n", F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key "), F.to_json(F.struct(*keys))))).otherwise(n)).where("_n > 0").drop("_n")


def join_checked(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join whose right side must have each key once."""
    return left.join(assert_unique(right, [key]), key, how)


def spread_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", count: str | None = None, often: int = 1000) -> DataFrame:
    """Rows joined to a table that has each key once, where any key may be that of most rows.

    Keys of more than one row in ``often`` - fewer than ``often`` of them - are broadcast; the others
    are joined by a shuffle.  ``count`` names a column of the table with the rows of each key (which
    goes); without it the rows are counted.  Null keys are equal.  ``how``: inner or left."""
    keys = list(keys)
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    rest = [c for c in table.columns if c not in keys and c != count]
    counted = table.select(*(F.col(k).alias(n) for k, n in named.items()), *rest, F.lit(True).alias("_found"), *([F.col(count).alias("_rows")] if count else []))

    def same(names: dict[str, str]) -> Column:
        out = F.lit(True)
        for k, n in names.items():
            out = out & F.col(k).eqNullSafe(F.col(n))
        return out

    if not count:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
        sizes = sizes.select(*(F.col(k).alias(f"_s{n}") for k, n in named.items()), "_rows")
        on = F.lit(True)
        for n in named.values():
            on = on & F.col(n).eqNullSafe(F.col(f"_s{n}"))
        counted = checkpointed(counted.join(sizes, on).drop(*(f"_s{n}" for n in named.values())))
    total = rows.agg(F.count("*").alias("_total"))  # one row
    counted = counted.crossJoin(F.broadcast(total)).withColumn("_often", F.col("_rows") * often > F.col("_total")).drop("_rows", "_total")
    hot = F.broadcast(counted.where("_often"))
    mine = rows.join(hot, same(named))
    others = rows.join(hot, same(named), "left_anti").join(counted.where("not _often"), same(named), how)
    return mine.unionByName(others).drop(*named.values(), "_often", "_found")


def dedupe(df: DataFrame, keys: Sequence[str], order: str, last: bool = False) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc(order) if last else F.asc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def rank_slice(df: DataFrame, rank: str, first: int, last: int) -> DataFrame:
    return df.where(F.col(rank).between(first, last))


def coverage_counts(df: DataFrame, label: str, sentinel: str = "NO_TEMPLATE") -> DataFrame:
    named = F.col(label) != sentinel
    return df.agg(F.count("*").alias("total"), F.count_if(~named).alias("sentinel"), F.count_if(named).alias("labelled"), F.round(F.count_if(named) / F.count("*"), 6).alias("labelled_share"))


def score_summary(df: DataFrame, group: str, entity: str, scores: Sequence[str], digits: int = 6, means: Sequence[str] = ()) -> DataFrame:
    """Rows and entities of every group, mean and median of ``scores``, and the plain mean of ``means``."""
    from .ordered import with_medians

    aggs = [F.avg(s).alias(f"mean_{s}") for s in scores]
    out = df.groupBy(group).agg(F.count("*").alias("posts"), F.count_distinct(entity).alias("templates"), *aggs, *(F.avg(c).alias(c) for c in means))
    out = with_medians(out, df, [group], scores)
    return out.select(group, "posts", "templates", *(F.round(f"{n}_{s}", digits).alias(f"{n}_{s}") for s in scores for n in ("mean", "median")), *means)


def composition_share(df: DataFrame, group: str, category: str) -> DataFrame:
    n = df.groupBy(group, category).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(group)), 6))


def class_order(df: DataFrame, column: str, order: Sequence[str] = CLASS_ORDER) -> DataFrame:
    """Position of each class: the given order, then unknown ones by name."""
    known = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    classes = df.select(column).distinct()
    w = W.orderBy(F.when(known > 0, known).otherwise(len(order) + 1), column)  # one row a class
    unknown = F.row_number().over(w)
    positions = classes.withColumn("known", known).withColumn("r", unknown)
    first_unknown = F.min(F.when(F.col("known") == 0, F.col("r"))).over(W.partitionBy())
    positions = positions.select(column, F.when(F.col("known") > 0, F.col("known")).otherwise(len(order) + 1 + F.col("r") - first_unknown).cast("int").alias("position"))
    return df.join(positions, column)


def pairs_within(df: DataFrame, group: str, key: str) -> DataFrame:
    """Unordered pairs of a group's keys; for small entity tables, as its rows grow with their square."""
    a, b = df.select(group, F.col(key).alias("a")), df.select(group, F.col(key).alias("b"))
    return a.join(b, group).where("a < b")


def drop_small_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(W.partitionBy(label))).where(F.col("_n") >= least).drop("_n")


def by_hash(key: str, seed: int) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def one_per_label(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    one = df.withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy(by_hash(key, seed), key))).where("_r = 1").drop("_r")
    return one.orderBy(by_hash(label, seed), label).limit(k)


def zscore(df: DataFrame, columns: Sequence[str], constant: float = 0.0) -> DataFrame:
    """(x - mean) / population deviation; ``constant`` without any."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))  # one row
    z = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(constant)) for c in columns}
    return out.withColumns(z).select(*df.columns)


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of current without those whose key changes, and the changes."""
    return current.join(changes, key, "left_anti").unionByName(changes, allowMissingColumns=True)


def last_per_key(df: DataFrame, key: str, sequence: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_b"))
    return best.select(key, *(F.col(f"_b.{c}").alias(c) for c in rest))


def join_with_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str = "_tpl") -> DataFrame:
    """Left join in which clashing columns of the right side get a suffix."""
    clash = set(left.columns) - {key}
    right = right.select(key, *(F.col(c).alias(c + suffix if c in clash else c) for c in right.columns if c != key))
    return left.join(right, key, "left")


def outer_assemble(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """All keys of any frame, with each frame's columns joined to them."""
    keys = frames[0].select(key)
    for f in frames[1:]:
        keys = keys.unionByName(f.select(key))
    out = keys.distinct()
    for f in frames:
        out = out.join(f, key, "left")
    return out


def missing_scored(texts: DataFrame, cache: DataFrame, text: str, scorer: Column) -> DataFrame:
    """Scores of all distinct texts: those cached by their hash, the others scored, as (hash, score)."""
    wanted = texts.select(F.sha1(text).alias("hash"), F.col(text).alias("t")).dropDuplicates(["hash"])
    new = wanted.join(cache, "hash", "left_anti").select("hash", scorer.alias("score"))
    return cache.join(wanted, "hash", "left_semi").unionByName(new)


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The given columns in order and type, null where missing."""
    have = set(df.columns)
    return df.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
