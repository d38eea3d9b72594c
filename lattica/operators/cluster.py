"""Clustering, cluster description, density clustering on hashes, and evaluation."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import dot, l2_normalise
from .cells import matrix
from .hashes import dbscan_hamming  # noqa: F401
from .neighbors import centroids_by_label
from .relational import checkpointed


def vectorised(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    a = F.col(columns) if isinstance(columns, str) else F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    return df.withColumn("features", array_to_vector(a))


def standardise(df: DataFrame, columns: Sequence[str], constant: float = 0.0) -> DataFrame:
    """Columns as z-scores by the population deviation; ``constant`` without any."""
    from .relational import zscore

    return zscore(df, columns, constant)


#: Starts of k-means, and how many of them are fitted at a time.
STARTS, AT_ONCE = 20, 4


def kmeans(df: DataFrame, k: int, seeds: Sequence[int] = tuple(range(1, STARTS + 1))) -> DataFrame:
    """Rows with a ``cluster``, by the cheapest of several seeded k-means models on ``features``."""
    data = df.persist()
    try:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            models = list(pool.map(lambda s: KMeans(k=k, seed=s, maxIter=30).fit(data), seeds))
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()
    return best.transform(df).withColumnRenamed("prediction", "cluster")


def gmm(df: DataFrame, k: int, seeds: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Rows with a ``cluster``, by the likeliest of several seeded Gaussian mixtures on ``features``."""
    data = df.persist()
    try:
        models = [GaussianMixture(k=k, seed=s, maxIter=30).fit(data) for s in seeds]
        best = max(models, key=lambda m: m.summary.logLikelihood)
    finally:
        data.unpersist()
    return best.transform(df).withColumnRenamed("prediction", "cluster").drop("probability")


def bisecting(df: DataFrame, k: int, seed: int = 1) -> DataFrame:
    return BisectingKMeans(k=k, seed=seed).fit(df).transform(df).withColumnRenamed("prediction", "cluster")


def relabelled(df: DataFrame, order: Column) -> DataFrame:
    """Clusters numbered from 0 by an aggregate of their rows, then by their old number."""
    new = df.groupBy("cluster").agg(order.alias("o"))
    new = new.select("cluster", (F.row_number().over(W.orderBy("o", "cluster")) - 1).alias("new"))  # one row a cluster
    return df.join(F.broadcast(new), "cluster").drop("cluster").withColumnRenamed("new", "cluster")


def curves_as_arrays(matrix: DataFrame) -> DataFrame:
    """One row a template with its values in the order of periods."""
    return matrix.groupBy("template_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "value"))), lambda s: s["value"]).alias("curve"))


def _dtw(a: np.ndarray, b: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Squared dynamic time warping cost of two curves and the path of aligned positions.

    Cells of one diagonal do not depend on each other, so each is one array operation.
    """
    n, m = len(a), len(b)
    c = np.full((n + 1, m + 1), np.inf)
    c[0, 0] = 0.0
    d = (a[:, None] - b[None, :]) ** 2
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        c[i, j] = d[i - 1, j - 1] + np.minimum(c[i - 1, j - 1], np.minimum(c[i - 1, j], c[i, j - 1]))
    path, i, j = [], n, m
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda x: c[x])
    return float(c[n, m]), path


def _aligned(starts: list[list[np.ndarray]]):
    """Every curve with its nearest centre of each start, position by position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, curve in zip(b["template_key"], b["curve"]):
                for number, centres in enumerate(starts):
                    best = min(((*_dtw(c, np.asarray(curve)), k) for k, c in enumerate(centres)), key=lambda x: (x[0], x[2]))
                    rows += [(key, number, best[2], best[0], t, curve[s]) for t, s in best[1]]
            yield pd.DataFrame(rows, columns=["template_key", "start", "cluster", "cost", "t", "value"])

    return run


def dtw_kmeans(curves: DataFrame, k: int, rounds: int = 20, starts: int = 10) -> DataFrame:
    """Templates with a cluster by k-means under time warping, the cheapest of several starts.

    A start takes k curves as its centres, which are as long as a curve.  Each round aligns every
    curve with the centres of all starts and takes the mean of the values aligned with each position
    as the next centre (a barycentre step), until no start gets cheaper or ``rounds`` are over.
    """
    schema = "template_key string, start int, cluster int, cost double, t int, value double"
    seeds = None
    for i in range(starts):
        own = curves.select("curve", F.xxhash64("template_key", F.lit(i)).alias("o"), "template_key").orderBy("o", "template_key").limit(k)
        own = own.select(F.lit(i).alias("start"), "o", "template_key", "curve")
        seeds = own if seeds is None else seeds.unionByName(own)
    centres: list[list[np.ndarray]] = [[] for _ in range(starts)]
    for r in seeds.orderBy("start", "o", "template_key").collect():  # k curves a start
        centres[r.start].append(np.asarray(r.curve))
    before = math.inf
    for _ in range(rounds):
        if not centres[0]:
            break
        aligned = checkpointed(curves.mapInPandas(_aligned(centres), schema))
        cost = aligned.where("t = 0").dropDuplicates(["template_key", "start"]).groupBy("start").agg(F.sum("cost").alias("cost")).agg(F.sum("cost")).first()[0]
        if not cost < before * (1 - 1e-9):
            break
        before = cost
        new = [[c.copy() for c in x] for x in centres]
        for r in aligned.groupBy("start", "cluster", "t").agg(F.avg("value").alias("v")).collect():  # k curves a start
            new[r.start][r.cluster][r.t] = r.v
        centres = new
    final = curves.mapInPandas(_aligned(centres), schema).groupBy("template_key", "start").agg(F.first("cluster").alias("cluster"), F.first("cost").alias("cost"))
    final = checkpointed(final)
    best = final.groupBy("start").agg(F.round(F.sum("cost"), 9).alias("total")).orderBy("total", "start").limit(1).select("start")
    return final.join(F.broadcast(best), "start").drop("start")


def cluster_profiles(rows: DataFrame, columns: Sequence[str], weights: dict[str, dict[str, float]]) -> DataFrame:
    """Size and mean z-scores of every cluster, and its score for every named class."""
    p = rows.groupBy("cluster").agg(F.count("*").alias("size"), *(F.avg(c).alias(c) for c in columns))

    def score(w: dict[str, float]) -> Column:
        total = F.lit(0.0)
        for c, x in w.items():
            total = total + x * F.col(c)
        return total

    return p.select("*", *(score({c: x for c, x in w.items() if c in columns}).alias(f"score_{name}") for name, w in weights.items()))


def manual_names(text: str, names: Sequence[str]) -> dict[int, str]:
    """Names by cluster of a text like "0=evergreen, 2=bursty"."""
    out = {}
    for item in filter(None, map(str.strip, text.split(","))):
        cluster, sign, name = item.partition("=")
        name = name.strip().lower().replace(" ", "_")
        if not sign or name not in names:
            raise ValueError(f"{item!r} is not cluster=name with one of {list(names)}")
        out[int(cluster)] = name
    return out


def cluster_naming(profiles: DataFrame, names: Sequence[str], manual: str = "") -> DataFrame:
    """The one-to-one naming of up to six clusters with the largest total score; others are cluster_i.

    All permutations of the few clusters are rows, joined with the scores.  With ``manual`` names
    those count instead, and clusters without one are cluster_i.
    """
    if given := manual_names(manual, names):
        own = F.create_map(*(F.lit(x) for pair in given.items() for x in pair))[F.col("cluster").cast("int")]
        return profiles.select("cluster", F.coalesce(own, F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))).alias("name"))
    k = min(len(names), 6)
    ids = profiles.select("cluster").orderBy("cluster").limit(6)
    numbered = ids.withColumn("i", F.row_number().over(W.orderBy("cluster")) - 1)
    n = numbered.count()
    places = [list(p) for p in itertools.permutations(range(max(n, k)), min(n, k))] if n <= k else [list(p) for p in itertools.permutations(range(n), k)]
    # With fewer clusters than names a permutation lists a name for each cluster, else a cluster for each name.
    rows = [(j, (x, i) if n > k else (i, x)) for j, p in enumerate(places) for i, x in enumerate(p)]
    perms = profiles.sparkSession.createDataFrame([(j, c, m) for j, (c, m) in rows], "j long, i int, m int")
    named = F.array(*map(F.lit, names))
    scores = profiles.select("cluster", F.posexplode(F.array(*(F.col(f"score_{x}") for x in names))).alias("m", "s")).join(numbered, "cluster")
    total = perms.join(scores, ["i", "m"]).groupBy("j").agg(F.sum("s").alias("total"))
    best = total.orderBy(F.desc(F.round("total", 9)), "j").limit(1)
    chosen = perms.join(F.broadcast(best), "j").join(numbered, "i").select("cluster", F.get(named, F.col("m")).alias("name"))
    return profiles.select("cluster").join(chosen, "cluster", "left").select("cluster", F.coalesce("name", F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))).alias("name"))


def representatives(rows: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """The n rows of every cluster that are near its mean of ``v`` and large: the rank by distance
    and 0.65 times the rank by size, both dense, are added; (cluster, key, place)."""
    c = rows.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    apart = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y))
    x = rows.join(F.broadcast(c), "cluster").withColumn("d", F.round(apart, 9))  # one row a cluster
    w = W.partitionBy("cluster")
    x = x.withColumn("r", F.dense_rank().over(w.orderBy("d")) + 0.65 * F.dense_rank().over(w.orderBy(F.desc(size))))
    return x.withColumn("place", F.row_number().over(w.orderBy("r", key))).where(F.col("place") <= n).select("cluster", key, "place")


def davies_bouldin(rows: DataFrame, vector: str) -> DataFrame:
    """Davies and Bouldin's index of ``cluster`` over vectors; clusters' pairs only are joined."""
    long = rows.select("cluster", F.posexplode(vector).alias("i", "x"))
    c = long.groupBy("cluster", "i").agg(F.avg("x").alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))

    def distance(a: str, b: str) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    spread = rows.join(c, "cluster").groupBy("cluster").agg(F.avg(distance(vector, "c")).alias("s"), F.first("c").alias("c"))
    a, b = spread.select(F.col("cluster").alias("a"), F.col("s").alias("sa"), F.col("c").alias("ca")), spread.select(F.col("cluster").alias("b"), F.col("s").alias("sb"), F.col("c").alias("cb"))
    r = a.crossJoin(b).where("a <> b").groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / distance("ca", "cb")).alias("r"))
    return r.agg(F.avg("r").alias("davies_bouldin"))


#: Numbers of a block of vectors whose distances to another block's one task works out, at most, and rows.
BLOCK_NUMBERS, BLOCK_ROWS = 1 << 20, 1 << 14


def _by_cluster(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, vectors and weights in the order of clusters, the clusters and where each begins."""
    c = t.column("cluster").to_numpy()
    o = np.argsort(c, kind="stable")
    ids, start = np.unique(c[o], return_index=True)
    return t.column("key").to_numpy()[o], matrix(t.column("v"))[o], t.column("w").to_numpy()[o].astype(float), ids, start


def _summed(keys: np.ndarray, ids: np.ndarray, sums: np.ndarray) -> pa.Table:
    return pa.table({"key": np.repeat(keys, len(ids)), "other": np.tile(ids, len(keys)), "total": sums.ravel()})


def _distance_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of the distances of every row of both blocks to the rows of each cluster of the other one;
    of a block with itself, once.

    A matrix product gives squared distances; those lost in rounding, and what is not finite, are worked out
    by differences.
    """
    if not (left.num_rows and right.num_rows):
        return pa.table({"key": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})
    itself = left.column("b")[0].as_py() == right.column("c2")[0].as_py()
    (kx, x, wx, cx, sx), (ky, y, wy, cy, sy) = _by_cluster(left), _by_cluster(right)
    xx, yy, yt = (x * x).sum(axis=1), (y * y).sum(axis=1), np.ascontiguousarray(y.T)
    out, back = np.zeros((len(x), len(cy))), np.zeros((len(y), len(cx)))

    def parts(start: np.ndarray, n: int, first: int, last: int) -> list[tuple[int, slice]]:
        """The clusters of the rows from first to last, each with its rows."""
        ends, k = [*start[1:].tolist(), n], int(np.searchsorted(start, first, side="right")) - 1
        found = []
        while k < len(start) and start[k] < last:
            found.append((k, slice(max(int(start[k]), first), min(ends[k], last))))
            k += 1
        return found

    across = {i: parts(sx, len(x), i, min(i + 128, len(x))) for i in range(0, len(x), 128)}
    with np.errstate(invalid="ignore"):
        for j in range(0, len(y), 512):  # tiles that stay in a core's cache
            q, down = slice(j, j + 512), parts(sy, len(y), j, min(j + 512, len(y)))
            tile = np.ascontiguousarray(yt[:, q])
            for i, held in across.items():
                p = slice(i, i + 128)
                d = x[p] @ tile
                d *= -2
                d += xx[p, None]
                d += yy[q]
                lost = 1e-6 * (xx[p].max() + yy[q].max())
                if not d.min() > lost:
                    at, of = np.nonzero(~(d > lost))
                    for k in range(0, len(at), 16384):
                        r, c = at[k : k + 16384], of[k : k + 16384]
                        d[r, c] = ((x[i + r] - y[j + c]) ** 2).sum(axis=1)
                np.sqrt(d, out=d)
                for k, c in down:
                    out[p, k] += d[:, c.start - j : c.stop - j] @ wy[c]
                if not itself:
                    for k, r in held:
                        back[q, k] += wx[r] @ d[r.start - i : r.stop - i]
    found = _summed(kx, cy, out)
    return found if itself else pa.concat_tables([found, _summed(ky, cx, back)])


def silhouette(rows: DataFrame, key: str, vector: str, block: int | None = None) -> DataFrame:
    """Mean silhouette by Euclidean distance over all rows; keys are unique.

    Equal rows of a cluster become one with a weight.  Those are dealt into blocks, and a task works out
    the distances of one pair of blocks for both sides, so what leaves it is rows times clusters, never
    pairs.  The index needs every distance: the work grows with the square of the distinct rows, and
    n ** 2 / block copies of them are shuffled; a task holds two blocks.  Rows without a key take no part;
    those without a cluster or vector count as 0 and are in no cluster's mean.
    """
    given = rows.where(F.col(key).isNotNull()).select(F.col("cluster").cast("long").alias("cluster"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.col("cluster").isNotNull() & F.col("v").isNotNull()
    x = given.where(usable).groupBy("cluster", "v").agg(F.count("*").alias("w"))
    x = checkpointed(x.withColumn("key", F.monotonically_increasing_id()))  # written, so that both sides see the same numbers
    total, size = x.agg(F.count("*"), F.max(F.size("v"))).first()
    largest = block or max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, size or 1)))
    n = math.ceil(total / largest) if block else max(math.ceil(total / largest), min(16, math.ceil(total / 2048)))
    mine = F.pmod(F.xxhash64("key"), F.lit(max(1, n)).cast("long"))
    zero, last = F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long")
    left = x.withColumn("b", mine).withColumn("c", F.explode(F.sequence("b", last)))
    right = x.withColumn("c2", mine).withColumn("b2", F.explode(F.sequence(zero, "c2")))
    sums = left.groupBy("b", "c").cogroup(right.groupBy("b2", "c2")).applyInArrow(_distance_sums, "key long, other long, total double")
    sizes = x.groupBy(F.col("cluster").alias("other")).agg(F.sum("w").alias("n"))
    m = sums.groupBy("key", "other").agg(F.sum("total").alias("total")).join(sizes, "other").join(x.select("key", "cluster", "w"), "key")
    own, same = F.col("other") == F.col("cluster"), F.col("total") / (F.col("n") - 1)
    s = m.groupBy("key", "w").agg(F.max(F.when(own & (F.col("n") > 1), same)).alias("own"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("near"))
    value = F.when(F.col("own").isNull(), 0.0).otherwise(F.when((F.col("near") == 0) & (F.col("own") == 0), float("nan")).otherwise((F.col("near") - F.col("own")) / F.greatest("near", "own")))
    s = s.select("w", value.alias("s")).where("s is not null").agg(F.sum(F.col("s") * F.col("w")).alias("s"), F.sum("w").alias("n"))
    others = given.agg(F.count("*").alias("all"), F.count_if(~usable).alias("none"))  # one row, as the other
    of = F.coalesce("n", F.lit(0)) + F.col("none")
    return s.crossJoin(F.broadcast(others)).select(F.when((F.col("all") > 1) & (of > 0), F.coalesce("s", F.lit(0.0)) / of).alias("silhouette"))


def refine_clusters(rows: DataFrame, steps: int = 3) -> DataFrame:
    """(key, v, cluster): reassigned to the nearest unit centroid by cosine and recentred, so often;
    emptied clusters vanish."""
    from .neighbors import top2

    for _ in range(steps):
        c = centroids_by_label(rows, "cluster", "v")
        best = top2(rows.select("key", "v"), c, "key", "v", "cluster").select("key", F.col("best_label").alias("cluster"))
        rows = checkpointed(rows.drop("cluster").join(best, "key"))
    return rows


def prototype_update(seeds: DataFrame, pseudo: DataFrame, beta: float) -> DataFrame:
    """(sum of seeds + beta * sum of pseudo-labelled) / (their weights), unit length; rows: label, v."""
    both = seeds.select("label", "v", F.lit(1.0).alias("w")).unionByName(pseudo.select("label", "v", F.lit(beta).alias("w")))
    long = both.select("label", "w", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    arrays = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return arrays.select("label", l2_normalise("c").alias("centroid"))


def text_classifier(train: DataFrame, rows: DataFrame, tokens: str, label: str, terms: int = 1 << 12):
    """A multinomial logistic regression of ``label`` (0, 1, ..) on hashed tf-idf terms of ``tokens``, in
    which each class weighs alike; the model and the rows with ``prediction`` and ``confidence``.

    The penalty is one over the number of rows.  Rows without tokens have a class by the intercepts.
    """
    sizes = train.groupBy(label).agg(F.count("*").alias("n_c"))  # one row a class
    n, k = sizes.agg(F.coalesce(F.sum("n_c"), F.lit(0)), F.count("*")).first()
    weighted = train.join(F.broadcast(sizes), label).withColumn("weight", n / (k * F.col("n_c")))
    steps = [HashingTF(inputCol=tokens, outputCol="tf", numFeatures=terms), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features")]
    regression = LogisticRegression(family="multinomial", labelCol=label, weightCol="weight", regParam=1.0 / max(n, 1), standardization=False, maxIter=30)
    model = Pipeline(stages=[*steps, regression]).fit(weighted)
    return model, model.transform(rows).withColumn("confidence", F.array_max(vector_to_array("probability")))


def pca_reduce(rows: DataFrame, vector: str, d: int) -> DataFrame:
    """Projection of centred vectors on d components, scaled to unit length."""
    long = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    mean = long.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))  # one vector
    c = rows.crossJoin(F.broadcast(mean)).withColumn("features", array_to_vector(F.zip_with(vector, "mean", lambda x, y: x - y)))
    out = PCA(k=d, inputCol="features", outputCol="p").fit(c).transform(c)
    return out.withColumn("reduced", l2_normalise(vector_to_array("p"))).drop("features", "p", "mean")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest id reachable from every id: (id, component); edges: a, b.

    Labels spread along the edges and jump to their label's label in each round, which is written.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpointed(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = step.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        after = checkpointed(step.join(jump, "c", "left").select("id", F.coalesce("cc", "c").alias("component")))
        changed = after.join(labels.withColumnRenamed("component", "before"), "id").where("component <> before").limit(1).count()
        labels = after
        if not changed:
            return labels


def majority_hash(rows: DataFrame, bits: int = 64) -> DataFrame:
    """Majority bits of every cluster's hashes, and the member nearest to them (smallest key on ties)."""
    from ..functions.scalars import hamming, pack_bits

    flags = [F.call_function("shiftrightunsigned", "hash", F.lit(i)).bitwiseAND(F.lit(1).cast("long")) for i in range(bits)]
    means = rows.groupBy("cluster").agg(*(F.avg(f).alias(f"b{i}") for i, f in enumerate(flags)))
    m = means.select("cluster", pack_bits(F.array(*(F.col(f"b{i}") >= 0.5 for i in range(bits)))).alias("majority"))
    best = rows.join(m, "cluster").groupBy("cluster", "majority").agg(F.min(F.struct(hamming("hash", "majority").alias("distance"), "key")).alias("m"))
    return best.select("cluster", "majority", F.col("m.key").alias("medoid"), F.col("m.distance").alias("distance"))


def majority_vote_label(rows: DataFrame, cluster: str, label: str, unknown: int = -1) -> DataFrame:
    """Most frequent label of every cluster, the smallest on ties; noise (-1) is unknown."""
    n = rows.groupBy(cluster, label).agg(F.count("*").alias("n"))
    best = n.groupBy(cluster).agg(F.max(F.struct("n", (-F.col(label)).alias("l"))).alias("m"))
    return best.select(cluster, F.when(F.col(cluster) == -1, unknown).otherwise(-F.col("m.l")).alias("label"))


def classification_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, weighted and macro precision, recall and F1 (0 where undefined), Matthews' and
    Cohen's coefficients over the labels of either column, from one table of counts."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    long = cells.select(F.explode(F.array(F.struct(F.col("t").alias("l"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("p").alias("l"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    by = long.groupBy("l").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    pr, re = F.when(F.col("p") > 0, F.col("h") / F.col("p")).otherwise(0.0), F.when(F.col("t") > 0, F.col("h") / F.col("t")).otherwise(0.0)
    by = by.withColumn("precision", pr).withColumn("recall", re)
    by = by.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    names = ("precision", "recall", "f1")
    s = by.agg(F.sum("t").alias("n"), F.sum("h").alias("hits"), F.sum(F.col("t").cast("double") * F.col("p")).alias("tp"), F.sum(F.col("t").cast("double") * F.col("t")).alias("tt"), F.sum(F.col("p").cast("double") * F.col("p")).alias("pp"), *(F.avg(c).alias(f"macro_{c}") for c in names), *((F.sum(F.col(c) * F.col("t")) / F.sum("t")).alias(f"weighted_{c}") for c in names))
    n, h = F.col("n").cast("double"), F.col("hits").cast("double")
    root = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    mcc = F.when(root > 0, (h * n - F.col("tp")) / root).otherwise(0.0)
    expected = F.col("tp") / (n * n)
    kappa = F.when(expected < 1, (h / n - expected) / (1 - expected)).otherwise(0.0)
    return s.select("n", (h / n).alias("accuracy"), *(f"{a}_{c}" for a in ("weighted", "macro") for c in names), mcc.alias("mcc"), kappa.alias("kappa"))


def metrics_with_rejection(rows: DataFrame, truth: str, predicted: str, accepted: str) -> DataFrame:
    ok = F.col(accepted)
    right = F.col(truth) == F.col(predicted)
    return rows.agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("coverage"), F.count_if(ok & right).alias("covered_right"), (F.count_if(ok & right) / F.nullif(F.count_if(ok), F.lit(0))).alias("covered_accuracy"), F.count_if(~ok).alias("rejected"))
