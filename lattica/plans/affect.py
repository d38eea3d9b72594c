"""Queries on affect scores, transitions, topics and statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import affect as op
from ..operators import relational as rel
from ..operators import statistics as st
from ..operators.popularity import prepare_posts
from .base import AFFECTS, DOMINANT, POSTS, PREPARED, THRESHOLD, affect, dominant_sql, posts, query, scores, table

LABELS = sc.AFFECT
GRID = ", ".join(f"('{x}')" for x in LABELS)


def _pairs(spark, d):
    return op.dominant_pairs(affect(spark, d), scores("global"), scores("local"), ("key", "topic"))


def _counts(spark, d):
    return op.transition_counts(_pairs(spark, d), LABELS, THRESHOLD)


def _rounded(df, *names: str):
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


@query("dominant_label", f"WITH {DOMINANT} SELECT key, global_label, round(global_score, 6) AS global_score, local_label, round(local_score, 6) AS local_score FROM dom")
def dominant_label(spark, d):
    return _rounded(_pairs(spark, d).drop("topic"), "global_score", "local_score")


_S = sc.SENTIMENTS


@query("finalise_affect", f"""WITH {AFFECTS}, x AS (SELECT key, coalesce(({dominant_sql('global')}).l, 'unavailable') AS ge, coalesce(({dominant_sql('local')}).l, 'unavailable') AS le,
        coalesce(({dominant_sql('global', _S)}).l, 'unavailable') AS gs, coalesce(({dominant_sql('local', _S)}).l, 'unavailable') AS ls FROM affect)
    SELECT key, ge AS global_label, le AS local_label, gs AS global_sentiment, ls AS local_sentiment, ge <> le AS label_mismatch, gs <> ls AS sentiment_mismatch FROM x""")  # fmt: skip
def finalise_affect(spark, d):
    a = affect(spark, d)
    ge, le, gs, ls = (sc.dominant(scores(c, k))[0] for c, k in (("global", LABELS), ("local", LABELS), ("global", _S), ("local", _S)))
    return a.select("key", ge.alias("global_label"), le.alias("local_label"), gs.alias("global_sentiment"), ls.alias("local_sentiment"), (ge != le).alias("label_mismatch"), (gs != ls).alias("sentiment_mismatch"))


_E = [f"{k}_global" for k in sc.EMOTIONS]
_ESQL = f"[{', '.join(_E)}]"


@query("affect_derived", f"""WITH {AFFECTS}, x AS (SELECT *, {_ESQL} AS e, list_sum({_ESQL}) AS t FROM affect)
    SELECT key, round(abs(positive_global - negative_global), 6) AS strength, round(2 * least(positive_global, negative_global) / nullif(positive_global + negative_global, 0), 6) AS ambivalence,
           round(list_max(e), 6) AS intensity,
           CASE WHEN len(list_filter(e, lambda v: v IS NULL)) = 0 AND t > 0 THEN round(list_sum(list_transform(e, lambda v: CASE WHEN v > 0 THEN -v / t * ln(v / t) ELSE 0 END)) / ln(11), 6) END AS entropy FROM x""")  # fmt: skip
def affect_derived(spark, d):
    p, n = F.col("positive_global"), F.col("negative_global")
    cols = {"strength": F.abs(p - n), "ambivalence": F.when(p.isNotNull() & n.isNotNull(), sc.ambivalence(p, n)), "intensity": F.greatest(*_E), "entropy": sc.score_entropy(*_E)}
    return affect(spark, d).select("key", *(F.round(c, 6).alias(k) for k, c in cols.items()))


@query("sentiment_balance", f"WITH {AFFECTS} SELECT key, round(coalesce(positive_global, 0) - coalesce(negative_global, 0), 6) AS global_balance, round(coalesce(positive_local, 0) - coalesce(negative_local, 0), 6) AS local_balance FROM affect")
def sentiment_balance(spark, d):
    return affect(spark, d).select("key", *(F.round(sc.sentiment_balance(f"positive_{c}", f"negative_{c}"), 6).alias(f"{c}_balance") for c in ("global", "local")))


@query("polarity_label", f"WITH {AFFECTS}, x AS (SELECT key, coalesce(positive_global, 0) - coalesce(negative_global, 0) AS b FROM affect) SELECT key, CASE WHEN b >= 0.05 THEN 'positive' WHEN b <= -0.05 THEN 'negative' ELSE 'neutral' END AS polarity FROM x")
def polarity_label(spark, d):
    return affect(spark, d).select("key", sc.polarity_label(sc.sentiment_balance("positive_global", "negative_global")).alias("polarity"))


@query("one_hot_from_label", f"WITH {AFFECTS}, x AS (SELECT key, coalesce(({dominant_sql('global', _S)}).l, 'unavailable') AS l FROM affect) SELECT key, {', '.join(f'CAST(l = {chr(39)}{k}{chr(39)} AS INTEGER) AS {k}' for k in _S)} FROM x")
def one_hot_from_label(spark, d):
    label = sc.dominant(scores("global", _S))[0]
    return affect(spark, d).select("key", *((label == k).cast("int").alias(k) for k in _S))


@query("backfill_missing_affect", f"WITH {AFFECTS} SELECT key, round(coalesce(positive_global, (key % 7) / 10.0), 6) AS positive_global, positive_global IS NULL AS rescored FROM affect")
def backfill_missing_affect(spark, d):
    a = affect(spark, d)
    missing = F.col("positive_global").isNull()
    fresh = a.where(missing).select("key", ((F.col("key") % 7) / 10.0).alias("fresh"))
    return a.join(fresh, "key", "left").select("key", F.round(F.coalesce("positive_global", "fresh"), 6).alias("positive_global"), missing.alias("rescored"))


_T = f"""{DOMINANT}, grid AS (SELECT g.l AS global_label, m.l AS local_label FROM (VALUES {GRID}) g(l) CROSS JOIN (VALUES {GRID}) m(l)),
    c AS (SELECT global_label, local_label, count(*) AS n FROM dom WHERE global_score >= {THRESHOLD} AND local_score >= {THRESHOLD} GROUP BY 1, 2),
    t AS (SELECT global_label, local_label, coalesce(n, 0) AS n FROM grid LEFT JOIN c USING (global_label, local_label)),
    tc AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY global_label), 0) AS p FROM t)"""


@query("transition_counts", f"WITH {_T} SELECT global_label, local_label, n, round(p, 6) AS p FROM tc")
def transition_counts(spark, d):
    return _rounded(_counts(spark, d), "p")


@query("transition_alignment", f"""WITH {_T}, b AS (SELECT global_label, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN global_label = local_label THEN n ELSE 0 END) AS BIGINT) AS aligned FROM tc GROUP BY 1),
    e AS (SELECT * FROM b UNION ALL SELECT 'OVERALL', CAST(sum(n) AS BIGINT), CAST(sum(aligned) AS BIGINT) FROM b) SELECT *, round(aligned / nullif(n, 0), 6) AS rate FROM e""")  # fmt: skip
def transition_alignment(spark, d):
    return _rounded(op.alignment(_counts(spark, d)), "rate")


@query("transition_neutral_injection", f"WITH {_T} SELECT local_label, n, round(p, 6) AS p FROM tc WHERE global_label = 'neutral'")
def transition_neutral_injection(spark, d):
    return _rounded(op.neutral_injection(_counts(spark, d)), "p")


@query("transition_incongruity", f"WITH {_T} SELECT global_label, local_label, n, CAST(row_number() OVER (ORDER BY n DESC, global_label, local_label) AS INTEGER) AS rank FROM tc WHERE global_label <> local_label AND n > 0")
def transition_incongruity(spark, d):
    return op.incongruity(_counts(spark, d))


@query("transition_share", f"""WITH {_T}, k AS (SELECT CASE WHEN global_label = local_label THEN 'aligned' WHEN local_label = 'neutral' THEN 'muted' ELSE 'transformed' END AS kind, CAST(sum(n) AS BIGINT) AS n FROM tc GROUP BY 1)
    SELECT kind, n, round(n / nullif(sum(n) OVER (), 0), 6) AS share FROM k""")  # fmt: skip
def transition_share(spark, d):
    return _rounded(op.transition_share(_counts(spark, d)), "share")


@query("threshold_cooccurrence", f"""WITH {AFFECTS}, g AS (UNPIVOT (SELECT key, {', '.join(f'{k}_global AS {k}' for k in LABELS)} FROM affect) ON COLUMNS(* EXCLUDE (key)) INTO NAME l VALUE s),
    m AS (UNPIVOT (SELECT key, {', '.join(f'{k}_local AS {k}' for k in LABELS)} FROM affect) ON COLUMNS(* EXCLUDE (key)) INTO NAME l VALUE s),
    c AS (SELECT g.l AS a, m.l AS b, count(*) AS n FROM g JOIN m USING (key) WHERE g.s >= {THRESHOLD} AND m.s >= {THRESHOLD} GROUP BY 1, 2)
    SELECT x.l AS global_label, y.l AS local_label, coalesce(n, 0) AS n FROM (VALUES {GRID}) x(l) CROSS JOIN (VALUES {GRID}) y(l) LEFT JOIN c ON a = x.l AND b = y.l""")  # fmt: skip
def threshold_cooccurrence(spark, d):
    return op.threshold_cooccurrence(affect(spark, d), scores("global"), scores("local"), LABELS, THRESHOLD)


@query("conditional_entropy", f"""WITH {_T} SELECT global_label, CAST(sum(n) AS BIGINT) AS n, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) + 0 AS entropy, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / log2(14), 6) + 0 AS entropy_norm FROM tc GROUP BY 1""")
def conditional_entropy(spark, d):
    e = op.conditional_entropy(_counts(spark, d))
    return e.select("global_label", "n", (F.round("entropy", 6) + 0).alias("entropy"), (F.round("entropy_norm", 6) + 0).alias("entropy_norm"))


@query("kl_to_marginal", f"""WITH {_T}, x AS (SELECT global_label, coalesce(p, 0) + 1e-12 AS a, coalesce(sum(n) OVER (PARTITION BY local_label) / nullif(sum(n) OVER (), 0), 0) + 1e-12 AS b FROM tc),
    y AS (SELECT global_label, a / sum(a) OVER (PARTITION BY global_label) AS a, b / sum(b) OVER (PARTITION BY global_label) AS b FROM x)
    SELECT global_label, round(sum(a * log2(a / b)), 6) AS kl FROM y GROUP BY 1""")  # fmt: skip
def kl_to_marginal(spark, d):
    return _rounded(op.kl_to_marginal(_counts(spark, d)), "kl")


@query("mutual_information", f"""WITH {_T}, x AS (SELECT n / sum(n) OVER () AS pxy, sum(n) OVER (PARTITION BY global_label) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY local_label) / sum(n) OVER () AS py FROM tc),
    m AS (SELECT sum(CASE WHEN pxy > 0 THEN pxy * log2(pxy / (px * py)) ELSE 0 END) AS mi, -sum(CASE WHEN px > 0 THEN px * log2(px) ELSE 0 END) / 14 AS hg, -sum(CASE WHEN py > 0 THEN py * log2(py) ELSE 0 END) / 14 AS hl FROM x)
    SELECT round(mi, 6) AS mutual_information, round(hg, 6) AS entropy_global, round(hl, 6) AS entropy_local, round(mi / nullif(least(hg, hl), 0), 6) AS nmi, round(hl - mi, 6) AS entropy_local_given_global FROM m""")  # fmt: skip
def mutual_information(spark, d):
    m = op.mutual_information(_counts(spark, d))
    return _rounded(m, *m.columns)


@query("dominant_summary", f"""WITH {DOMINANT}, s AS (SELECT global_label AS label, count(*) AS n, avg(global_score) AS m, median(global_score) AS md FROM dom WHERE global_score >= {THRESHOLD} GROUP BY 1)
    SELECT label, n, round(m, 6) AS mean_score, round(md, 6) AS median_score, round(n / sum(n) OVER (), 6) AS share FROM s""")  # fmt: skip
def dominant_summary(spark, d):
    return _rounded(op.dominant_summary(_pairs(spark, d), "global_label", "global_score", THRESHOLD), "mean_score", "median_score", "share")


@query("score_histogram", f"""WITH {AFFECTS}, s AS (SELECT min(joy_global) AS lo, max(joy_global) AS hi FROM affect),
    b AS (SELECT CAST(least(floor((joy_global - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM affect, s WHERE joy_global IS NOT NULL GROUP BY 1)
    SELECT r AS bin, coalesce(n, 0) AS n FROM range(20) t(r) LEFT JOIN b ON bin = r""")  # fmt: skip
def score_histogram(spark, d):
    return op.score_histogram(affect(spark, d), "joy_global", 20)


@query("histogram_smooth", f"""WITH {AFFECTS}, s AS (SELECT min(joy_global) AS lo, max(joy_global) AS hi FROM affect),
    b AS (SELECT CAST(least(floor((joy_global - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM affect, s WHERE joy_global IS NOT NULL GROUP BY 1),
    h AS (SELECT r AS bin, coalesce(n, 0) AS n FROM range(20) t(r) LEFT JOIN b ON bin = r)
    SELECT bin, n, round((lag(n, 2, 0) OVER w + 2 * lag(n, 1, 0) OVER w + 3 * n + 2 * lead(n, 1, 0) OVER w + lead(n, 2, 0) OVER w) / 9, 6) AS smooth FROM h WINDOW w AS (ORDER BY bin)""")  # fmt: skip
def histogram_smooth(spark, d):
    return _rounded(op.histogram_smooth(op.score_histogram(affect(spark, d), "joy_global", 20)), "smooth")


_METRICS = ("positive_global", "negative_global", "joy_global", "anger_global")


@query("class_affect_summary", f"""WITH {AFFECTS}, x AS (SELECT *, coalesce(({dominant_sql('global', _S)}).l, 'unavailable') AS sentiment FROM affect)
    SELECT CAST(topic AS VARCHAR) AS class, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS mean_{m}, round(median({m}), 6) AS median_{m}' for m in _METRICS)},
           {', '.join(f"round(count(*) FILTER (WHERE sentiment = '{s}') / count(*), 6) AS share_{s}" for s in _S)} FROM x GROUP BY 1""")  # fmt: skip
def class_affect_summary(spark, d):
    a = affect(spark, d).withColumn("sentiment", sc.dominant(scores("global", _S))[0])
    aggs = [F.round(f(m), 6).alias(f"{n}_{m}") for m in _METRICS for n, f in (("mean", F.avg), ("median", F.median))]
    shares = [F.round(F.count_if(F.col("sentiment") == s) / F.count("*"), 6).alias(f"share_{s}") for s in _S]
    return a.groupBy(F.col("topic").cast("string").alias("class")).agg(F.count("*").alias("n"), *aggs, *shares)


@query("template_affect_profile", f"WITH {AFFECTS} SELECT topic AS template, {', '.join(f'round(avg({k}_global), 6) AS {k}' for k in LABELS)} FROM affect GROUP BY 1")
def template_affect_profile(spark, d):
    return affect(spark, d).groupBy(F.col("topic").alias("template")).agg(*(F.round(F.avg(f"{k}_global"), 6).alias(k) for k in LABELS))


_TOPIC = f"""WITH {AFFECTS}, x AS (SELECT *, coalesce(positive_global, 0) - coalesce(negative_global, 0) AS balance FROM affect WHERE topic IS NOT NULL AND topic <> -1)"""


@query("topic_affect_summary", f"""{_TOPIC} SELECT topic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(balance), 6) AS mean_balance, round(median(love_local), 6) AS median_score FROM x GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, topic LIMIT 8""")
def topic_affect_summary(spark, d):
    from pyspark.sql import Window as W

    a = affect(spark, d).where("topic is not null and topic <> -1").withColumn("balance", sc.sentiment_balance("positive_global", "negative_global"))
    t = a.groupBy("topic").agg(F.count("*").alias("n"), F.avg("balance").alias("mean_balance"), F.median("love_local").alias("median_score"))
    t = t.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy())).where("n >= 5").orderBy(F.desc("n"), "topic").limit(8)
    return _rounded(t.select("topic", "n", "share", "mean_balance", "median_score"), "share", "mean_balance", "median_score")


@query("topic_share_by_group", f"""WITH {DOMINANT}, c AS (SELECT topic, global_label, count(*) AS n FROM dom GROUP BY 1, 2), g AS (SELECT t.topic, l.global_label FROM (SELECT DISTINCT topic FROM c) t CROSS JOIN (SELECT DISTINCT global_label FROM c) l)
    SELECT topic, global_label, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(n) OVER (PARTITION BY topic), 6) AS share FROM g LEFT JOIN c USING (topic, global_label)""")  # fmt: skip
def topic_share_by_group(spark, d):
    return st.share_grid(_pairs(spark, d), "topic", "global_label")


@query("zscore_columns", f"""WITH {AFFECTS} SELECT key, CASE WHEN stddev_pop(joy_global) OVER () > 0 THEN round((joy_global - avg(joy_global) OVER ()) / stddev_pop(joy_global) OVER (), 6) ELSE 0 END AS joy_global FROM affect WHERE joy_global IS NOT NULL""")
def zscore_columns(spark, d):
    return _rounded(rel.zscore(affect(spark, d).where("joy_global is not null").select("key", "joy_global"), ["joy_global"]), "joy_global")


_RANKS = "(rank() OVER (PARTITION BY m ORDER BY v) + (count(*) OVER (PARTITION BY m, v) - 1) / 2)"


@query("topic_affect_spearman", f"""WITH {AFFECTS}, t AS (SELECT topic, avg(love_local) AS engagement, avg(joy_global) AS joy, avg(anger_global) AS anger FROM affect GROUP BY 1),
    r AS (SELECT (rank() OVER (ORDER BY engagement) + (count(*) OVER (PARTITION BY engagement) - 1) / 2) AS e, (rank() OVER (ORDER BY joy) + (count(*) OVER (PARTITION BY joy) - 1) / 2) AS j, (rank() OVER (ORDER BY anger) + (count(*) OVER (PARTITION BY anger) - 1) / 2) AS a FROM t)
    SELECT 'joy' AS metric, round(corr(e, j), 6) AS rho FROM r UNION ALL SELECT 'anger', round(corr(e, a), 6) FROM r""")  # fmt: skip
def topic_affect_spearman(spark, d):
    t = affect(spark, d).groupBy("topic").agg(F.avg("love_local").alias("engagement"), F.avg("joy_global").alias("joy"), F.avg("anger_global").alias("anger"))
    return _rounded(st.spearman(t, "engagement", ["joy", "anger"]), "rho")


@query("jsd_groups", f"""WITH {DOMINANT}, c AS (SELECT topic, global_label AS l, count(*) AS n FROM dom GROUP BY 1, 2), p AS (SELECT topic, l, n / sum(n) OVER (PARTITION BY topic) AS p FROM c),
    g AS (SELECT a.topic AS a, b.topic AS b, l.l FROM (SELECT DISTINCT topic FROM c) a JOIN (SELECT DISTINCT topic FROM c) b ON a.topic < b.topic CROSS JOIN (SELECT DISTINCT l FROM c) l),
    x AS (SELECT g.a, g.b, coalesce(pa.p, 0) AS p, coalesce(pb.p, 0) AS q FROM g LEFT JOIN p pa ON pa.topic = g.a AND pa.l = g.l LEFT JOIN p pb ON pb.topic = g.b AND pb.l = g.l)
    SELECT a, b, round(sqrt(greatest(sum((CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2), 0)), 6) AS distance FROM x GROUP BY 1, 2""")  # fmt: skip
def jsd_groups(spark, d):
    p = _pairs(spark, d).withColumn("one", F.lit(1))
    return _rounded(op.jensen_shannon(p, "topic", "global_label", "one", math.e), "distance")


@query("distribution_profiles", f"""WITH {DOMINANT}, c AS (SELECT topic, local_label AS global_label, count(*) AS n FROM dom GROUP BY 1, 2), g AS (SELECT t.topic, l.global_label FROM (SELECT DISTINCT topic FROM c) t CROSS JOIN (SELECT DISTINCT global_label FROM c) l)
    SELECT topic, global_label AS local_label, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(n) OVER (PARTITION BY topic), 6) AS share FROM g LEFT JOIN c USING (topic, global_label)""")  # fmt: skip
def distribution_profiles(spark, d):
    return st.share_grid(_pairs(spark, d), "topic", "local_label")


@query("intra_cluster_distances", f"""WITH {DOMINANT}, c AS (SELECT topic, global_label AS l, count(*) AS n FROM dom GROUP BY 1, 2), s AS (SELECT topic, sum(n) AS w FROM c GROUP BY 1), p AS (SELECT topic, l, n / sum(n) OVER (PARTITION BY topic) AS p FROM c),
    g AS (SELECT a.topic AS a, b.topic AS b, l.l FROM (SELECT DISTINCT topic FROM c) a JOIN (SELECT DISTINCT topic FROM c) b ON a.topic < b.topic AND a.topic % 2 = b.topic % 2 CROSS JOIN (SELECT DISTINCT l FROM c) l),
    x AS (SELECT g.a, g.b, coalesce(pa.p, 0) AS p, coalesce(pb.p, 0) AS q FROM g LEFT JOIN p pa ON pa.topic = g.a AND pa.l = g.l LEFT JOIN p pb ON pb.topic = g.b AND pb.l = g.l),
    j AS (SELECT a, b, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2), 0)) AS dist FROM x GROUP BY 1, 2)
    SELECT CAST(a % 2 AS INTEGER) AS cluster, count(*) AS pairs, round(avg(dist), 6) AS mean, round(median(dist), 6) AS median, round(max(dist), 6) AS max, round(sum(dist * least(sa.w, sb.w)) / sum(least(sa.w, sb.w)), 6) AS weighted
    FROM j JOIN s sa ON sa.topic = a JOIN s sb ON sb.topic = b GROUP BY 1""")  # fmt: skip
def intra_cluster_distances(spark, d):
    p = _pairs(spark, d).withColumn("cluster", (F.col("topic") % 2).cast("int")).withColumn("one", F.lit(1))
    return st.intra_cluster_distances(p, "cluster", "topic", "global_label", "one")


@query("kruskal_wallis", f"""WITH {AFFECTS}, x AS (SELECT topic AS g, joy_global AS v FROM affect WHERE joy_global IS NOT NULL), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r, count(*) OVER () AS n FROM x),
    s AS (SELECT g, count(*) AS k, sum(r) AS sr, any_value(n) AS n FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*) AS c FROM x GROUP BY v))
    SELECT round((12.0 / (any_value(n) * (any_value(n) + 1)) * sum(sr * sr / k) - 3 * (any_value(n) + 1)) / (1 - any_value(t.t) / (pow(any_value(n), 3) - any_value(n))), 6) AS h, count(*) AS groups FROM s, t""")  # fmt: skip
def kruskal_wallis(spark, d):
    return _rounded(st.kruskal_wallis(affect(spark, d).where("joy_global is not null"), "topic", "joy_global"), "h").select("h", "groups")


@query("kruskal_wallis_p")
def kruskal_wallis_p(spark, d):
    return st.with_chi2_p(st.kruskal_wallis(affect(spark, d).where("joy_global is not null"), "topic", "joy_global"), "h", "dof")


_DESCRIBED = "m AS (SELECT g, avg(v) AS mean, median(v) AS median FROM x GROUP BY 1)"


@query("mann_whitney", f"""WITH {AFFECTS}, x AS (SELECT topic AS g, joy_global AS v FROM affect WHERE joy_global IS NOT NULL), {_DESCRIBED}, p AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM x) a JOIN (SELECT DISTINCT g FROM x) b ON a.g < b.g),
    y AS (SELECT p.a, p.b, x.g, x.v FROM p JOIN x ON x.g = p.a OR x.g = p.b), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2 AS r FROM y),
    s AS (SELECT a, b, sum(CASE WHEN g = a THEN r END) AS ra, count(*) FILTER (WHERE g = a) AS na, count(*) FILTER (WHERE g = b) AS nb FROM r GROUP BY 1, 2), t AS (SELECT a, b, sum(c * c * c) AS t FROM (SELECT a, b, count(*) AS c FROM y GROUP BY a, b, v) GROUP BY 1, 2),
    u AS (SELECT *, ra - na * (na + 1) / 2 AS u, sqrt(na * nb / 12.0 * (na + nb + 1 - (t - na - nb) / ((na + nb) * (na + nb - 1)))) AS sd FROM s JOIN t USING (a, b))
    SELECT a, b, na, nb, round(u, 4) AS u, round(2 * u / (na * nb) - 1, 6) AS rank_biserial, round(greatest(abs(u - na * nb / 2) - 0.5, 0) / nullif(sd, 0), 6) AS z, t > na + nb AS tied,
           round(ma.mean, 6) AS mean_a, round(mb.mean, 6) AS mean_b, round(ma.median, 6) AS median_a, round(mb.median, 6) AS median_b FROM u JOIN m ma ON ma.g = a JOIN m mb ON mb.g = b""")  # fmt: skip
def mann_whitney(spark, d):
    m = st.mann_whitney(affect(spark, d).where("joy_global is not null"), "topic", "joy_global")
    return _rounded(m.withColumn("u", F.round("u", 4)), "rank_biserial", "z", "mean_a", "mean_b", "median_a", "median_b")


@query("mann_whitney_p")
def mann_whitney_p(spark, d):
    return st.with_rank_sum_p(st.mann_whitney(affect(spark, d).where("joy_global is not null"), "topic", "joy_global"))


@query("ks_two_sample", f"""WITH {AFFECTS}, x AS (SELECT topic AS g, joy_global AS v FROM affect WHERE joy_global IS NOT NULL), {_DESCRIBED}, p AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM x) a JOIN (SELECT DISTINCT g FROM x) b ON a.g < b.g),
    y AS (SELECT p.a, p.b, x.v, count(*) FILTER (WHERE x.g = p.a) AS ca, count(*) FILTER (WHERE x.g = p.b) AS cb FROM p JOIN x ON x.g = p.a OR x.g = p.b GROUP BY 1, 2, 3),
    z AS (SELECT a, b, sum(ca) OVER w / sum(ca) OVER (PARTITION BY a, b) AS fa, sum(cb) OVER w / sum(cb) OVER (PARTITION BY a, b) AS fb FROM y WINDOW w AS (PARTITION BY a, b ORDER BY v))
    SELECT a, b, round(max(abs(fa - fb)), 6) AS d, round(any_value(ma.mean), 6) AS mean_a, round(any_value(mb.mean), 6) AS mean_b, round(any_value(ma.median), 6) AS median_a, round(any_value(mb.median), 6) AS median_b
    FROM z JOIN m ma ON ma.g = a JOIN m mb ON mb.g = b GROUP BY 1, 2""")  # fmt: skip
def ks_two_sample(spark, d):
    t = st.ks_two_sample(affect(spark, d).where("joy_global is not null"), "topic", "joy_global")
    return _rounded(t, "d", "mean_a", "mean_b", "median_a", "median_b").drop("na", "nb")


@query("ks_two_sample_p")
def ks_two_sample_p(spark, d):
    return st.with_ks_p(st.ks_two_sample(affect(spark, d).where("joy_global is not null"), "topic", "joy_global"))


# The chi-square tail by its finite sums: of exponentials for even degrees, and for odd ones of half powers after
# the normal tail, whose series is summed.
_CHI2_P = """CASE WHEN dof % 2 = 0 THEN exp(-chi2 / 2) * list_sum(list_transform(range(0, CAST(dof // 2 AS BIGINT)), lambda i: pow(chi2 / 2, i) / gamma(i + 1)))
    ELSE CASE WHEN chi2 > 50 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 150), lambda i: pow(-1, i) * pow(sqrt(chi2 / 2), 2 * i + 1) / (gamma(i + 1) * (2 * i + 1)))) END
         + coalesce(exp(-chi2 / 2) * list_sum(list_transform(range(1, CAST((dof - 1) // 2 + 1 AS BIGINT)), lambda i: pow(chi2 / 2, i - 0.5) / gamma(i + 0.5))), 0) END"""


@query("chi2_contingency", f"""WITH {DOMINANT}, c AS (SELECT topic AS r, coalesce(global_label, 'unavailable') AS c, count(*) AS n FROM dom GROUP BY 1, 2), g AS (SELECT x.r, y.c FROM (SELECT DISTINCT r FROM c) x CROSS JOIN (SELECT DISTINCT c FROM c) y),
    f AS (SELECT r, c, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (r, c)), e AS (SELECT n, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS e FROM f),
    t AS (SELECT (SELECT sum((n - e) * (n - e) / e) FROM e) AS chi2, CAST((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS BIGINT) AS dof, CAST(sum(n) AS BIGINT) AS total FROM f)
    SELECT round(chi2, 6) AS chi2, dof, total, round({_CHI2_P}, 6) AS p_value FROM t""")  # fmt: skip
def chi2_contingency(spark, d):
    t = st.with_chi2_p(st.chi2_contingency(_pairs(spark, d), "topic", "global_label"), "chi2", "dof")
    return _rounded(t, "chi2", "p_value")


@query("bh_qvalues", f"""WITH {AFFECTS}, t AS (SELECT key, joy_global AS p FROM affect WHERE joy_global IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY p, key) AS i, count(*) OVER () AS m FROM t)
    SELECT key, round(least(min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS q FROM r""")  # fmt: skip
def bh_qvalues(spark, d):
    t = affect(spark, d).where("joy_global is not null").select("key", F.col("joy_global").alias("p"))
    return _rounded(st.bh_qvalues(t, "p", "key").select("key", "q"), "q")


@query("affect_outer_merge", """SELECT coalesce(d.doc_id, l.doc_id) AS key, quality AS sentiment, n_chars AS emotion FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id""")
def affect_outer_merge(spark, d):
    a = table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("emotion"))
    b = rel.last_per_key(table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("sentiment")), "key", "sentiment")
    return b.join(a, "key", "full_outer").select("key", "sentiment", "emotion")


query("join_full_outer", """SELECT coalesce(d.doc_id, l.doc_id) AS key, quality AS sentiment, n_chars AS emotion FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id""")(affect_outer_merge)


@query("roc_gmean_threshold", """WITH x AS (SELECT l.quality AS y, n_chars / (n_chars + 1000.0::DOUBLE) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id), v AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM x GROUP BY 1),
    c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY s DESC) / sum(n) OVER () AS fpr FROM v)
    SELECT round(s, 6) AS threshold, round(sqrt(tpr * (1 - fpr)), 6) AS gmean FROM c ORDER BY sqrt(tpr * (1 - fpr)) DESC, s DESC LIMIT 1""")  # fmt: skip
def roc_gmean_threshold(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("s"))
    return _rounded(st.roc_gmean_threshold(x, "y", "s"), "threshold", "gmean")


@query("two_stage_reject", """SELECT l.doc_id AS key, CASE WHEN n_chars / (n_chars + 1000.0::DOUBLE) < 0.5 THEN 'reject' ELSE CAST(1 - toxic AS VARCHAR) END AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def two_stage_reject(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return x.select(F.col("doc_id").alias("key"), F.when(F.col("n_chars") / (F.col("n_chars") + 1000.0) < 0.5, "reject").otherwise((1 - F.col("toxic")).cast("string")).alias("label"))


@query("conversation_transitions", """WITH p AS (SELECT role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), c AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY 1, 2)
    SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM c""")  # fmt: skip
def conversation_transitions(spark, d):
    from pyspark.sql import Window as W

    c = table(spark, d, "conversations").select(F.col("role").alias("a"), F.lead("role").over(W.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    n = c.groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.round(F.col("n") / F.sum("n").over(W.partitionBy("a")), 6))


@query("attach_metadata_coalesce", f"WITH {POSTS}, {AFFECTS} SELECT p.key, round(coalesce(a.joy_global, p.score), 4) AS score FROM posts p LEFT JOIN affect a ON a.key = p.key")
def attach_metadata_coalesce(spark, d):
    a = affect(spark, d).select("key", F.col("joy_global").alias("meta"))
    return posts(spark, d).join(a, "key", "left").select("key", F.round(F.coalesce("meta", "score"), 4).alias("score"))


@query("attach_assignments", f"WITH {POSTS} SELECT p.key, p.template_final, e.label AS template_final_tpl FROM posts p LEFT JOIN embeddings e ON e.vec_id = p.key")
def attach_assignments(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("template_final"))
    return rel.join_with_suffix(posts(spark, d).select("key", "template_final"), e, "key")


@query("class_temporal_means", f"WITH {PREPARED}, t AS (SELECT template_key, count(*) AS n, avg(score) AS s FROM prepared GROUP BY 1) SELECT CASE WHEN n >= 100 THEN 'large' ELSE 'small' END AS class, count(*) AS templates, CAST(sum(n) AS BIGINT) AS posts, round(avg(n), 6) AS mean_posts, round(avg(s), 4) AS mean_score FROM t GROUP BY 1")
def class_temporal_means(spark, d):
    t = prepare_posts(posts(spark, d)).groupBy("template_key").agg(F.count("*").alias("n"), F.avg("score").alias("s"))
    return t.groupBy(F.when(F.col("n") >= 100, "large").otherwise("small").alias("class")).agg(F.count("*").alias("templates"), F.sum("n").alias("posts"), F.round(F.avg("n"), 6).alias("mean_posts"), F.round(F.avg("s"), 4).alias("mean_score"))
