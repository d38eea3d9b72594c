"""Token statistics, tf-idf, keywords and vocabulary comparison."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .affect import jensen_shannon
from .ordered import prefix_sums
from .relational import checkpointed


def exploded(rows: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    return rows.select(*keys, F.explode(tokens).alias("token"))


def token_stats(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Tokens, distinct tokens, their ratio, normalised entropy, concentration and the largest
    share of every row; 0 where there is no token.

    A row's tokens are counted in the row: they are sorted, and one pass adds up the runs of equal
    ones, so nothing is shuffled.
    """
    names = ("run", "distinct", "c_log_c", "squares", "most")

    def closed(s: Column) -> list[Column]:
        """The sums with the run that ends here."""
        c = s["run"]
        return [s["distinct"] + F.when(c > 0, 1.0).otherwise(0.0), s["c_log_c"] + F.when(c > 0, c * F.log(c)).otherwise(0.0), s["squares"] + c * c, F.greatest(s["most"], c)]

    def state(last: Column, *values: Column) -> Column:
        return F.struct(last.alias("last"), *(v.cast("double").alias(n) for n, v in zip(names, values)))

    def step(s: Column, token: Column) -> Column:
        more = state(token, s["run"] + 1, *(s[n] for n in names[1:]))
        return F.when(s["last"] == token, more).otherwise(state(token, F.lit(1.0), *closed(s)))

    def end(s: Column) -> Column:
        return F.struct(*(c.alias(n) for n, c in zip(names[1:], closed(s))))

    start = state(F.lit(None).cast("string"), *(F.lit(0.0) for _ in names))
    listed = rows.select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias("t"))
    x = listed.select(key, F.size("t").cast("long").alias("tokens"), F.aggregate(F.array_sort("t"), start, step, end).alias("s"))
    n, some = F.col("tokens"), F.col("tokens") > 0
    h = F.log(n) - F.col("s.c_log_c") / n

    def given(c: Column, otherwise: float = 0.0) -> Column:
        return F.when(some, c).otherwise(otherwise)

    return x.select(
        key,
        "tokens",
        F.col("s.distinct").cast("long").alias("distinct"),
        given(F.col("s.squares") / (n * n)).alias("hhi"),
        given(F.col("s.most") / n).alias("top1_share"),
        given(F.col("s.distinct") / n).alias("ttr"),
        F.when(F.col("s.distinct") > 1, h / F.log("s.distinct")).otherwise(0.0).alias("entropy_norm"),
    )


def class_token_profile(rows: DataFrame, group: str, tokens: Column) -> DataFrame:
    """Counts, shares and ranks of the tokens of every class."""
    n = exploded(rows, [group], tokens).groupBy(group, "token").agg(F.count("*").alias("n"))
    w = W.partitionBy(group)
    return n.select(group, "token", "n", (F.col("n") / F.sum("n").over(w)).alias("share"), F.row_number().over(w.orderBy(F.desc("n"), "token")).alias("rank"))


def pairwise_lexical_jsd(profile: DataFrame, group: str, k: int = 50) -> DataFrame:
    """Base-2 Jensen-Shannon distance of every two classes' tokens, and how many of their k first
    tokens they share."""
    d = jensen_shannon(profile, group, "token", "n", 2.0)
    top = profile.where(F.col("rank") <= k).select(group, "token")
    shared = top.select(F.col(group).alias("a"), "token").join(top.select(F.col(group).alias("b"), "token"), "token").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return d.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def topk_overlap(profile: DataFrame, group: str, k: int) -> DataFrame:
    """Common ones of two classes' k first tokens: how many, Jaccard similarity, and which."""
    top = profile.where(F.col("rank") <= k).groupBy(group).agg(F.array_sort(F.collect_set("token")).alias("t"))
    a, b = top.select(F.col(group).alias("a"), F.col("t").alias("x")), top.select(F.col(group).alias("b"), F.col("t").alias("y"))
    both = a.crossJoin(b).where("a < b")  # one row a class, k tokens each
    shared = F.array_sort(F.array_intersect("x", "y"))
    return both.select("a", "b", F.size(shared).alias("shared"), (F.size(shared) / F.size(F.array_union("x", "y"))).alias("jaccard"), F.array_join(shared, " ").alias("tokens"))


#: Tokens, the most frequent ones, whose weights are broadcast; the rows of the others are shuffled.
FREQUENT = 200_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token lists l and r of every row as its distinct tokens with their counts in both."""
    for b in batches:
        lists = [b.column("l"), b.column("r")]
        sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]
        flat = pa.concat_arrays([pc.list_flatten(x) for x in lists]).dictionary_encode()
        many = max(1, len(flat.dictionary))
        row = np.concatenate([np.repeat(np.arange(b.num_rows), n) for n in sizes])
        cells, at = np.unique(row * many + flat.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        cut = int(sizes[0].sum())
        counts = [pa.array(np.bincount(part, minlength=len(cells)).astype(np.int32)) for part in (at[:cut], at[cut:])]
        offsets = np.searchsorted(cells // many, np.arange(b.num_rows + 1)).astype(np.int32)
        t = pa.StructArray.from_arrays([flat.dictionary.take(pa.array(cells % many)), *counts], ["token", "l", "r"])
        names = [n for n in b.schema.names if n not in ("l", "r")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.ListArray.from_arrays(pa.array(offsets), t)], [*names, "t"])


def _documents(rows: DataFrame, keys: list[str], left: Column, right: Column) -> DataFrame:
    """A row for each value of ``keys``, written, with t: its distinct tokens and their counts on both sides.

    Tokens are counted within a row; only where a key is found twice are lists brought together."""
    x = rows.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), left.alias("l"), right.alias("r"))
    numbered = [f"k{i}" for i in range(len(keys))]
    if rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        x = x.groupBy(*numbered).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in "lr"))
    types = dict(x.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in numbered), "t array<struct<token: string, l: int, r: int>>"])
    return checkpointed(x.mapInArrow(_counted, schema)).withColumnsRenamed(dict(zip(numbered, keys)))


def _idf(docs: DataFrame, groups: list[str], n: DataFrame, df: Column) -> tuple[DataFrame, DataFrame | None]:
    """Weights of tokens, i: of FREQUENT frequent ones at most, and of the others, if any."""
    counts = _listed(docs).groupBy(*groups, "token").agg(df.alias("df"))
    counts = counts.join(F.broadcast(n), groups) if groups else counts.crossJoin(F.broadcast(n))  # a row a group, or one
    i = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    table = checkpointed(counts.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("token").alias("_token"), "df", i.alias("i")))
    if table.count() <= FREQUENT:
        return table.drop("df"), None
    sizes = prefix_sums(table, [], "df", {"c": F.count("*")})
    least = sizes.where(F.col("all_c") - F.col("before_c") - F.col("c") <= FREQUENT).agg(F.min("df")).first()[0]
    return table.where(F.col("df") > least).drop("df"), table.where(F.col("df") <= least).drop("df")


def _listed(docs: DataFrame) -> DataFrame:
    rest = [c for c in docs.columns if c != "t"]
    return docs.select(*rest, F.explode("t").alias("t")).select(*rest, "t.*")


def _with_idf(docs: DataFrame, groups: list[str], frequent: DataFrame) -> DataFrame:
    """Tokens of documents with their weights by a broadcast, so that they stay where their document is."""
    return _listed(docs).join(F.broadcast(frequent), _same(groups)).drop("_token", *(f"_{g}" for g in groups))


def _with_rare_idf(docs: DataFrame, groups: list[str], frequent: DataFrame, others: DataFrame) -> DataFrame:
    """The tokens left, which are in few documents each, with their weights; written."""
    x = _listed(docs).join(F.broadcast(frequent), _same(groups), "left_anti")
    return checkpointed(x.join(others, _same(groups)).drop("_token", *(f"_{g}" for g in groups)))


def _same(groups: list[str]) -> Column:
    same = F.col("token") == F.col("_token")
    for g in groups:
        same = same & (F.col(g) == F.col(f"_{g}"))
    return same


def tfidf(rows: DataFrame, key: str, tokens: Column, group: str | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """tf * (ln((1 + n) / (1 + df)) + 1), scaled to unit length in every document.

    With ``group`` n and df are of the document's group; ``carried`` columns of the document ride
    along.  Documents stay whole until their length is known: they are shuffled once to meet it, and only
    the rows of rare tokens are shuffled by token.
    """
    groups = [group] if group else []
    owners, keys = [*groups, key], list(dict.fromkeys([*groups, *carried, key]))
    docs = _documents(rows, keys, tokens, F.array().cast("array<string>"))
    frequent, others = _idf(docs, groups, rows.groupBy(*groups).agg(F.count("*").alias("n")), F.count("*"))
    rare = None if others is None else _with_rare_idf(docs, groups, frequent, others)
    w = F.col("l") * F.col("i")

    def squares(x: DataFrame) -> DataFrame:
        return x.select(*owners, (w * w).alias("s")).groupBy(*owners).agg(F.sum("s").alias("s"))

    s = squares(_with_idf(docs, groups, frequent))
    if rare is not None:
        s = s.unionByName(squares(rare)).groupBy(*owners).agg(F.sum("s").alias("s"))
    lengths = checkpointed(s.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(owners)), F.sqrt("s").alias("_length")))
    met = F.lit(True)
    for i, c in enumerate(owners):
        met = met & F.col(c).eqNullSafe(F.col(f"_o{i}"))

    def measured(x: DataFrame) -> DataFrame:
        return x.join(lengths.hint("shuffle_hash"), met).drop(*(f"_o{i}" for i in range(len(owners))))

    out = _with_idf(measured(docs), groups, frequent)
    if rare is not None:
        out = out.unionByName(measured(rare))
    return out.select(*groups, *carried, key, "token", F.col("l").cast("long").alias("tf"), (w / F.col("_length")).alias("w"))


def ngram_terms(tokens: Column) -> Column:
    """Tokens, and pairs of neighbouring ones."""
    pairs = F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(tokens, i + 1)))
    return F.concat(tokens, pairs)


def text_pair_cosine(rows: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """Cosine of two token lists of every row in the space of all lists; 0 without common tokens.

    Both lists stay in their row; what is shuffled is three sums of it, and the rows of rare tokens."""
    docs = _documents(rows, [key], left, right)
    held = (F.col("l") > 0).cast("int") + (F.col("r") > 0).cast("int")
    # Rows without a key count as one text, as their ids are null.
    frequent, others = _idf(docs, [], rows.agg((2 * F.count("*")).alias("n")), F.sum(F.when(F.col(key).isNull(), 1).otherwise(held)))

    def products(x: DataFrame) -> DataFrame:
        i = F.col("i") * F.col("i")
        return x.groupBy(key).agg(*(F.sum(F.col(a) * F.col(b) * i).alias(a + b) for a, b in ("lr", "ll", "rr")))

    p = products(_with_idf(docs, [], frequent))
    if others is not None:
        p = p.unionByName(products(_with_rare_idf(docs, [], frequent, others))).groupBy(key).agg(*(F.sum(c).alias(c) for c in ("lr", "ll", "rr")))
    sims = p.where("lr > 0").select(key, (F.col("lr") / F.sqrt(F.col("ll") * F.col("rr"))).alias("cosine"))
    return rows.select(key).join(sims, key, "left").select(key, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


# Thresholds and names of the classes.
def abstraction_class(origin_local: Column, global_local: Column, origin_global: Column) -> Column:
    return (
        F.when(origin_local >= 0.18, "origin-retaining reuse")
        .when((global_local >= origin_local) & (global_local >= 0.12), "structural abstraction")
        .when((origin_global >= 0.12) & (origin_local < 0.12), "origin-to-affordance shift")
        .otherwise("high local detachment")
    )


def topic_labels(rows: DataFrame, topic: str, key: str, tokens: Column, n: int = 5, docs: int = 400, features: int = 1500) -> DataFrame:
    """The n terms of every topic with the largest summed tf-idf within it, from its first ``docs``
    documents by key and its most frequent terms."""
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy(topic).orderBy(key))).where(F.col("_r") <= docs).drop("_r")
    terms = exploded(first, [topic], tokens).groupBy(topic, "token").agg(F.count("*").alias("c"))
    kept = terms.withColumn("_r", F.row_number().over(W.partitionBy(topic).orderBy(F.desc("c"), "token"))).where(F.col("_r") <= features).select(topic, "token")
    w = tfidf(first, key, tokens, topic).join(kept, [topic, "token"], "left_semi")
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(topic, key))))
    s = w.groupBy(topic, "token").agg(F.sum("w").alias("weight"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy(topic).orderBy(F.desc(F.round("weight", 9)), "token"))).where(F.col("rank") <= n)


def class_keywords(rows: DataFrame, group: str, key: str, tokens: Column, k: int = 20) -> DataFrame:
    """Terms by how far a class's unit centroid exceeds the best other one, times ln(1 + count)."""
    w = tfidf(rows, key, tokens, carried=[group])
    sizes = rows.groupBy(group).agg(F.count("*").alias("docs"))
    c = w.groupBy(group, "token").agg(F.sum("w").alias("s"), F.sum("tf").alias("n"))
    c = checkpointed(c.join(F.broadcast(sizes), group).withColumn("m", F.col("s") / F.col("docs")))
    lengths = c.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length"))  # a row a class
    c = c.join(F.broadcast(lengths), group).withColumn("m", F.col("m") / F.col("length"))
    by_token = W.partitionBy("token")
    c = c.withColumn("first", F.max(F.struct("m", group)).over(by_token))
    second = F.coalesce(F.max(F.when(F.col(group) != F.col(f"first.{group}"), F.col("m"))).over(by_token), F.lit(0.0))
    other = F.when(F.col(group) == F.col(f"first.{group}"), second).otherwise(F.col("first.m"))
    c = c.withColumn("weight", F.greatest(F.col("m") - other, F.lit(0.0)) * F.log1p("n")).where("weight > 0")
    return c.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.round("weight", 9)), "token"))).where(F.col("rank") <= k).select(group, "token", "n", "weight", "rank")
