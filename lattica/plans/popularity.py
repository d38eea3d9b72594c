"""Queries on popularity, series, windows, sampling and joins of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import EMOTIONS, SENTIMENTS
from ..operators import ordered as od
from ..operators import popularity as op
from ..operators import relational as rel
from .base import AFFECTS, POSTS, PREPARED, affect, min_posts, posts, query, table

DAY = "yyyy-MM-dd"


def _prepared(spark, d) -> DataFrame:
    return op.prepare_posts(posts(spark, d))


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _d(c: str):
    return F.date_format(c, DAY).alias(c)


@query("prepare_posts", f"""WITH {PREPARED}
    SELECT key, template_key, strftime(month, '%Y-%m-%d') AS month, strftime(CAST(date_trunc('week', created_utc) AS DATE), '%Y-%m-%d') AS week,
           CAST(year(created_utc) AS INTEGER) AS year, CAST(isodow(created_utc) - 1 AS INTEGER) AS weekday, CAST(hour(created_utc) AS INTEGER) AS hour,
           round(ln(1 + greatest(score, 0)), 6) AS log_score,
           round((rank() OVER (PARTITION BY month ORDER BY score) + (count(*) OVER (PARTITION BY month, score) - 1) / 2) / count(*) OVER (PARTITION BY month), 6) AS month_score_pct
    FROM prepared""")  # fmt: skip
def prepare_posts(spark, d):
    return _prepared(spark, d).select("key", "template_key", _d("month"), _d("week"), "year", "weekday", "hour", _r("log_score"), _r("month_score_pct"))


@query("calendar_parts", f"""WITH {POSTS}
    SELECT key, strftime(date_trunc('month', created_utc), '%Y-%m-%d') AS month, strftime(date_trunc('week', created_utc), '%Y-%m-%d') AS week,
           CAST(year(created_utc) AS INTEGER) AS year, CAST(isodow(created_utc) - 1 AS INTEGER) AS weekday, CAST(hour(created_utc) AS INTEGER) AS hour FROM posts""")  # fmt: skip
def calendar_parts(spark, d):
    from ..functions.scalars import calendar_parts as parts

    return posts(spark, d).withColumns(parts("created_utc")).select("key", _d("month"), _d("week"), "year", "weekday", "hour")


@query("pct_rank_avg_ties", f"""WITH {PREPARED}
    SELECT key, round((rank() OVER (PARTITION BY month ORDER BY score) + (count(*) OVER (PARTITION BY month, score) - 1) / 2) / count(*) OVER (PARTITION BY month), 6) AS pct FROM prepared""")  # fmt: skip
def pct_rank(spark, d):
    return od.with_pct_rank(_prepared(spark, d).select("key", "month", "score"), ["month"], "score", "pct").select("key", _r("pct"))


_DISPLAY = """, spelled AS (SELECT template_key, template_final, count(*) AS n FROM prepared GROUP BY 1, 2),
    display AS (SELECT template_key, template_final AS template_display, variants FROM (
        SELECT *, row_number() OVER (PARTITION BY template_key ORDER BY n DESC, template_final) AS r, count(*) OVER (PARTITION BY template_key) AS variants FROM spelled) WHERE r = 1)"""


@query("display_label", f"WITH {PREPARED}{_DISPLAY} SELECT * FROM display")
def display_label(spark, d):
    return op.display_label(_prepared(spark, d))


_POPULAR = """, popular AS (
    SELECT *, posts * 365.25 / observed_days AS posts_per_observed_year, posts * 365.25 / active_days AS posts_per_active_year FROM (
        SELECT template_key, count(*) AS posts, min(created_utc) AS first_seen, max(created_utc) AS last_seen, avg(score) AS mean_score, median(score) AS median_score,
               greatest(CAST(floor(epoch((SELECT max(created_utc) FROM prepared) - min(created_utc)) / 86400) AS BIGINT), 1) + 1 AS observed_days,
               greatest(CAST(floor(epoch(max(created_utc) - min(created_utc)) / 86400) AS BIGINT), 0) + 1 AS active_days
        FROM prepared GROUP BY 1))"""


@query("template_popularity", f"""WITH {PREPARED}{_POPULAR}
    SELECT template_key, posts, strftime(first_seen, '%Y-%m-%d') AS first_seen, strftime(last_seen, '%Y-%m-%d') AS last_seen, round(mean_score, 3) AS mean_score, round(median_score, 3) AS median_score,
           observed_days, active_days, round(posts_per_observed_year, 6) AS posts_per_observed_year, round(posts_per_active_year, 6) AS posts_per_active_year,
           CAST(row_number() OVER (ORDER BY posts DESC, posts_per_observed_year DESC, template_key) AS INTEGER) AS rank, CAST(dense_rank() OVER (ORDER BY posts DESC) AS INTEGER) AS dense_rank FROM popular""")  # fmt: skip
def template_popularity(spark, d):
    p = op.template_popularity(_prepared(spark, d))
    return p.select("template_key", "posts", _d("first_seen"), _d("last_seen"), _r("mean_score", 3), _r("median_score", 3), "observed_days", "active_days", _r("posts_per_observed_year"), _r("posts_per_active_year"), "rank", "dense_rank")


@query("rank_first_unique", f"""WITH {PREPARED}{_POPULAR}
    SELECT template_key, CAST(row_number() OVER (ORDER BY posts DESC, template_key) AS INTEGER) AS rank FROM popular""")  # fmt: skip
def rank_first_unique(spark, d):
    n = _prepared(spark, d).groupBy("template_key").count()
    return n.select("template_key", F.row_number().over(W.orderBy(F.desc("count"), "template_key")).alias("rank"))


@query("rank_dense", f"WITH {PREPARED}{_POPULAR} SELECT template_key, CAST(dense_rank() OVER (ORDER BY posts DESC) AS INTEGER) AS rank FROM popular")
def rank_dense(spark, d):
    n = _prepared(spark, d).groupBy("template_key").count()
    return n.select("template_key", F.dense_rank().over(W.orderBy(F.desc("count"))).alias("rank"))


@query("eligible_templates", f"""WITH {PREPARED}{_POPULAR}
    SELECT template_key, posts, observed_days, CAST(row_number() OVER (ORDER BY posts_per_observed_year DESC, template_key) AS INTEGER) AS eligible_rank FROM popular WHERE posts >= 20 AND observed_days >= 90""")  # fmt: skip
def eligible_templates(spark, d):
    return op.eligible_templates(op.template_popularity(_prepared(spark, d)), min_posts(d)).select("template_key", "posts", "observed_days", "eligible_rank")


@query("top_k_slice", f"""WITH {PREPARED}{_POPULAR}, ranked AS (
    SELECT template_key, posts, CAST(row_number() OVER (ORDER BY posts_per_observed_year DESC, template_key) AS INTEGER) AS eligible_rank FROM popular WHERE posts >= 20 AND observed_days >= 90)
    SELECT * FROM ranked WHERE eligible_rank BETWEEN 11 AND 20""")  # fmt: skip
def top_k_slice(spark, d):
    e = op.eligible_templates(op.template_popularity(_prepared(spark, d)), min_posts(d))
    return rel.rank_slice(e, "eligible_rank", 11, 20).select("template_key", "posts", "eligible_rank")


@query("overall_volume", f"""WITH {PREPARED}, n AS (SELECT month, count(*) AS posts FROM prepared GROUP BY 1),
    every AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM n)::TIMESTAMP, (SELECT max(month) FROM n)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month)
    SELECT strftime(month, '%Y-%m-%d') AS period, coalesce(posts, 0) AS posts FROM every LEFT JOIN n USING (month)""")  # fmt: skip
def overall_volume(spark, d):
    return op.overall_volume(_prepared(spark, d)).select(_d("period"), "posts")


_CURVE = """, n AS (SELECT template_key, month, count(*) AS posts FROM prepared GROUP BY 1, 2),
    span AS (SELECT template_key, unnest(generate_series(min(month)::TIMESTAMP, (SELECT max(month) FROM n)::TIMESTAMP, INTERVAL 1 MONTH)) AS period FROM n GROUP BY 1),
    filled AS (SELECT span.template_key, CAST(period AS DATE) AS period, coalesce(posts, 0) AS posts FROM span LEFT JOIN n ON span.template_key = n.template_key AND CAST(period AS DATE) = month),
    smoothed AS (SELECT *, avg(posts) OVER (PARTITION BY template_key ORDER BY period ROWS 2 PRECEDING) AS smooth, row_number() OVER (PARTITION BY template_key ORDER BY period) AS pos FROM filled),
    curve AS (SELECT *, smooth / greatest(max(smooth) OVER (PARTITION BY template_key), 1.0) AS smooth_norm FROM smoothed)"""


def _curve(spark, d) -> DataFrame:
    return op.lifecycle_curve(_prepared(spark, d))


@query("lifecycle_curve", f"WITH {PREPARED}{_CURVE} SELECT template_key, strftime(period, '%Y-%m-%d') AS period, posts, round(smooth, 6) AS smooth, round(smooth_norm, 6) AS smooth_norm FROM curve")
def lifecycle_curve(spark, d):
    return _curve(spark, d).select("template_key", _d("period"), "posts", _r("smooth"), _r("smooth_norm"))


@query("rolling_mean", f"WITH {PREPARED}{_CURVE} SELECT template_key, strftime(period, '%Y-%m-%d') AS period, round(smooth, 6) AS smooth FROM curve")
def rolling_mean(spark, d):
    return _curve(spark, d).select("template_key", _d("period"), _r("smooth"))


@query("rolling_run_flag", f"""WITH {PREPARED}{_CURVE}
    SELECT template_key, strftime(period, '%Y-%m-%d') AS period,
           sum(CASE WHEN posts = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY template_key ORDER BY period ROWS 1 PRECEDING) = 2 AS run FROM curve""")  # fmt: skip
def rolling_run_flag(spark, d):
    run = F.sum((F.col("posts") == 0).cast("int")).over(op.trailing("template_key", "period", 2)) == 2
    return _curve(spark, d).select("template_key", _d("period"), run.alias("run"))


_EVENTS = """, peaks AS (SELECT *, max(smooth) OVER (PARTITION BY template_key) AS peak_smooth FROM curve),
    placed AS (SELECT *, min(CASE WHEN smooth = peak_smooth THEN pos END) OVER (PARTITION BY template_key) AS peak_pos FROM peaks),
    runs AS (SELECT *, sum(CASE WHEN pos > peak_pos AND smooth <= 0.5 * peak_smooth THEN 1 ELSE 0 END) OVER (PARTITION BY template_key ORDER BY period ROWS 2 PRECEDING) AS low,
                    sum(CASE WHEN pos > peak_pos AND posts = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY template_key ORDER BY period ROWS 5 PRECEDING) AS zero FROM placed),
    events AS (SELECT template_key, strftime(min(period), '%Y-%m-%d') AS first_period, strftime(min(CASE WHEN pos = peak_pos THEN period END), '%Y-%m-%d') AS peak_period,
                      strftime(min(CASE WHEN low = 3 THEN period END), '%Y-%m-%d') AS decline_start, strftime(min(CASE WHEN zero = 6 THEN period END), '%Y-%m-%d') AS expiry,
                      count(*) FILTER (WHERE posts > 0) AS active_periods, count(*) AS observed_periods FROM runs GROUP BY 1)"""


@query("lifecycle_events", f"WITH {PREPARED}{_CURVE}{_EVENTS} SELECT * FROM events")
def lifecycle_events(spark, d):
    e = op.lifecycle_events(_curve(spark, d))
    return e.select("template_key", *(_d(c) for c in ("first_period", "peak_period", "decline_start", "expiry")), "active_periods", "observed_periods")


def flagship(spark, d, min_posts: int = 20) -> DataFrame:
    """The ten templates with most posts per observed year and their lifecycle events."""
    p = _prepared(spark, d)
    top = op.eligible_templates(op.template_popularity(p), min_posts).where("eligible_rank <= 10").select("template_key", "posts", _r("posts_per_observed_year"), "eligible_rank")
    own = p.join(F.broadcast(top), "template_key", "left_semi")  # ten rows
    end = p.agg(F.max("created_utc").alias("created_utc")).withColumn("template_key", F.lit(""))
    curves = op.lifecycle_curve(own.select("template_key", "created_utc").unionByName(end)).where("template_key <> ''")
    events = op.lifecycle_events(curves)
    named = top.join(op.display_label(own).select("template_key", "template_display"), "template_key")
    return named.join(events, "template_key").select("eligible_rank", "template_display", "posts", "posts_per_observed_year", *(_d(c) for c in ("first_period", "peak_period", "decline_start", "expiry")), "active_periods", "observed_periods")


query("top_lifecycles", f"""WITH {PREPARED}{_DISPLAY}{_POPULAR}{_CURVE}{_EVENTS}, ranked AS (
    SELECT template_key, posts, round(posts_per_observed_year, 6) AS posts_per_observed_year, CAST(row_number() OVER (ORDER BY posts_per_observed_year DESC, template_key) AS INTEGER) AS eligible_rank FROM popular WHERE posts >= 20 AND observed_days >= 90)
    SELECT eligible_rank, template_display, posts, posts_per_observed_year, first_period, peak_period, decline_start, expiry, active_periods, observed_periods
    FROM ranked JOIN display USING (template_key) JOIN events USING (template_key) WHERE eligible_rank <= 10""")(flagship)  # fmt: skip


_ISLANDS = """, flagged AS (SELECT *, posts > 0 AS active, row_number() OVER (PARTITION BY template_key ORDER BY pos) - row_number() OVER (PARTITION BY template_key, posts > 0 ORDER BY pos) AS g FROM curve),
    islands AS (SELECT template_key, active, g, count(*) AS n FROM flagged GROUP BY 1, 2, 3),
    runs2 AS (SELECT template_key, count(*) FILTER (WHERE active) AS active_runs, greatest(count(*) FILTER (WHERE active) - 1, 0) AS reactivations,
                     coalesce(max(CASE WHEN NOT active THEN n END), 0) AS longest_zero_run FROM islands GROUP BY 1)"""


@query("runs_islands", f"WITH {PREPARED}{_CURVE}{_ISLANDS} SELECT * FROM runs2")
def runs_islands(spark, d):
    return op.runs_islands(_curve(spark, d))


@query("cumsum_half", f"""WITH {PREPARED}{_CURVE}, c AS (
    SELECT *, sum(posts) OVER (PARTITION BY template_key ORDER BY pos) AS s, sum(posts) OVER (PARTITION BY template_key) AS t FROM curve)
    SELECT template_key, min(pos) AS periods_to_half FROM c WHERE s >= 0.5 * t GROUP BY 1""")  # fmt: skip
def cumsum_half(spark, d):
    key = W.partitionBy("template_key")
    c = _curve(spark, d).withColumn("s", F.sum("posts").over(key.orderBy("pos"))).withColumn("t", F.sum("posts").over(key))
    return c.where("s >= 0.5 * t").groupBy("template_key").agg(F.min("pos").cast("long").alias("periods_to_half"))


_FEATURES = """, base AS (
    SELECT template_key, pos, CAST(posts AS DOUBLE) AS v, sum(posts) OVER k AS total, count(*) OVER k AS n, sum(posts) OVER (PARTITION BY template_key ORDER BY pos) AS cumulative,
           row_number() OVER (PARTITION BY template_key ORDER BY posts DESC, pos) AS place, max(posts) OVER k AS peak FROM curve WINDOW k AS (PARTITION BY template_key)),
    based AS (SELECT *, min(CASE WHEN place = 1 THEN pos END) OVER (PARTITION BY template_key) AS peak_pos, least(n, 3) AS w, v / greatest(total, 1) AS p FROM base),
    measured AS (
        SELECT template_key, any_value(total) AS total, any_value(n) AS n, count(*) FILTER (WHERE v > 0) AS act, any_value(peak) AS peak, any_value(peak_pos) AS peak_pos,
               sum(CASE WHEN place <= 3 THEN v ELSE 0 END) AS top3, coalesce(median(v) FILTER (WHERE v > 0), 0) AS med, coalesce(avg(v) FILTER (WHERE v > 0), 0) AS mn,
               sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS entropy, sum(p * p) AS hhi, sum(CASE WHEN pos > peak_pos THEN v ELSE 0 END) AS after_peak,
               count(*) FILTER (WHERE pos > peak_pos AND v > 0) AS after_active, count(*) FILTER (WHERE pos > peak_pos) AS after_n, sum(CASE WHEN pos < peak_pos THEN v ELSE 0 END) AS before_peak,
               min(CASE WHEN cumulative >= 0.5 * total THEN pos END) AS half, sum(CASE WHEN pos > n - w THEN v ELSE 0 END) AS recent,
               sum(CASE WHEN pos <= n - w AND pos > n - 2 * w THEN v ELSE 0 END) AS previous, coalesce(regr_slope(CASE WHEN pos > n - 6 THEN p END, pos), 0) AS slope
        FROM based GROUP BY 1),
    features AS (
        SELECT template_key, CAST(total AS DOUBLE) AS total_posts, n AS observed_periods, act AS active_periods, act / n AS active_ratio, CAST(peak AS DOUBLE) AS peak_count, peak / total AS peak_share, top3 / total AS top3_share,
               peak / greatest(med, 1) AS peak_to_median_active, ln(1 + peak / greatest(med, 1)) AS peak_to_median_active_log, peak / greatest(mn, 1) AS peak_to_mean_active,
               CASE WHEN n > 1 THEN entropy / ln(n) ELSE 0 END AS entropy_norm, hhi, active_runs, active_runs / n AS active_run_density, reactivations, reactivations / greatest(active_runs, 1) AS reactivation_ratio,
               longest_zero_run, longest_zero_run / n AS longest_zero_ratio, after_peak / total AS post_peak_share, CASE WHEN after_n > 0 THEN after_active / after_n ELSE 0 END AS post_peak_active_ratio,
               before_peak / total AS pre_peak_share, half AS periods_to_half, half / n AS half_ratio, (n - peak_pos) / greatest(n - 1, 1) AS peak_age_ratio, 1 - (n - peak_pos) / greatest(n - 1, 1) AS peak_recency_ratio,
               recent / total AS recent_share_3, CASE WHEN n > 3 THEN previous / total ELSE 0 END AS previous_share_3, ln((recent + 1) / (CASE WHEN n > 3 THEN previous ELSE 0 END + 1)) AS recent_growth_log, slope AS recent_slope,
               peak / total + top3 / total + ln(1 + peak / greatest(med, 1)) AS virality_index
        FROM measured JOIN runs2 USING (template_key))"""

COUNTS = ("observed_periods", "active_periods", "active_runs", "reactivations", "longest_zero_run", "periods_to_half")
SHAPES = ("total_posts", "active_ratio", "peak_count", "peak_share", "top3_share", "peak_to_median_active", "peak_to_median_active_log", "peak_to_mean_active", "entropy_norm", "hhi", "active_run_density", "reactivation_ratio", "longest_zero_ratio", "post_peak_share", "post_peak_active_ratio", "pre_peak_share", "half_ratio", "peak_age_ratio", "peak_recency_ratio", "recent_share_3", "previous_share_3", "recent_growth_log", "recent_slope", "virality_index")
FEATURES_SQL = f"{PREPARED}{_CURVE}{_ISLANDS}{_FEATURES}"


@query("lifecycle_features", f"WITH {FEATURES_SQL} SELECT template_key, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in COUNTS)}, {', '.join(f'round({c}, 6) AS {c}' for c in SHAPES)} FROM features")
def lifecycle_features(spark, d):
    f = op.lifecycle_features(_curve(spark, d))
    return f.select("template_key", *(F.col(c).cast("long").alias(c) for c in COUNTS), *(_r(c) for c in SHAPES))


@query("curve_matrix", f"""WITH {PREPARED}{_POPULAR}, n AS (SELECT template_key, month, count(*) AS posts FROM prepared GROUP BY 1, 2),
    every AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM n)::TIMESTAMP, (SELECT max(month) FROM n)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month),
    s AS (SELECT t.template_key, e.month, avg(coalesce(n.posts, 0)) OVER (PARTITION BY t.template_key ORDER BY e.month ROWS 2 PRECEDING) AS smooth
          FROM (SELECT template_key FROM popular WHERE posts >= 20) t CROSS JOIN every e LEFT JOIN n ON n.template_key = t.template_key AND n.month = e.month)
    SELECT template_key, strftime(month, '%Y-%m-%d') AS period, round(CASE WHEN max(smooth) OVER (PARTITION BY template_key) > 0 THEN smooth / max(smooth) OVER (PARTITION BY template_key) ELSE 0 END, 6) AS value FROM s""")  # fmt: skip
def curve_matrix(spark, d):
    p = _prepared(spark, d)
    chosen = p.groupBy("template_key").count().where(F.col("count") >= min_posts(d))
    return op.curve_matrix(p, chosen).select("template_key", _d("period"), _r("value"))


@query("centroid_features", f"""WITH {PREPARED}, n AS (SELECT month, count(*) AS posts FROM prepared GROUP BY 1),
    c AS (SELECT *, row_number() OVER (ORDER BY month) AS pos, posts > 0.05 * max(posts) OVER () AS active FROM n)
    SELECT 'all' AS template_key, count(*) AS observed_periods, count(*) FILTER (WHERE active) AS active_periods, round(max(posts) / sum(posts), 6) AS peak_share FROM c""")  # fmt: skip
def centroid_features(spark, d):
    n = op.overall_volume(_prepared(spark, d)).withColumn("template_key", F.lit("all"))
    n = n.withColumn("pos", F.row_number().over(W.partitionBy("template_key").orderBy("period"))).withColumn("floor", 0.05 * F.max("posts").over(W.partitionBy("template_key")))
    shifted = n.withColumn("v", F.when(F.col("posts") > F.col("floor"), F.col("posts")).otherwise(0))
    f = op.lifecycle_features(n, "posts").join(op.lifecycle_features(shifted, "v").select("template_key", F.col("active_periods").alias("above")), "template_key")
    return f.select("template_key", "observed_periods", F.col("above").alias("active_periods"), _r("peak_share"))


_GROUPS = """, groups AS (SELECT template_key, posts, CASE WHEN low <= 15 THEN 'unpopular' WHEN top <= 15 THEN 'popular' END AS "group" FROM (
    SELECT *, row_number() OVER (ORDER BY posts DESC, template_key) AS top, row_number() OVER (ORDER BY posts, template_key) AS low FROM popular WHERE posts >= 20) WHERE low <= 15 OR top <= 15)"""


@query("popularity_groups", f"WITH {PREPARED}{_POPULAR}{_GROUPS} SELECT * FROM groups")
def popularity_groups(spark, d):
    return op.popularity_groups(op.template_popularity(_prepared(spark, d)), 15, min_posts(d))


_SCORED_POSTS = f"""{PREPARED}, {AFFECTS}, scored AS (SELECT prepared.*, affect.* EXCLUDE (key), positive_global - negative_global AS global_sentiment_balance, positive_local - negative_local AS local_sentiment_balance FROM prepared LEFT JOIN affect USING (key))"""


def _scored(spark, d):
    """Posts with the affect scores of their key, and balances, null where a score is."""
    return op.with_balances(_prepared(spark, d).join(affect(spark, d), "key", "left"))


_ALL_SCORES = [*op.BALANCES, *(f"{k}_{c}" for c in ("global", "local") for k in (*SENTIMENTS, *EMOTIONS))]


@query("group_affect_summary", f"""WITH {_SCORED_POSTS}{_POPULAR}{_GROUPS}
    SELECT "group", count(*) AS posts, count(DISTINCT template_key) AS templates, round(avg(score), 4) AS mean_score, round(median(score), 4) AS median_score, {", ".join(f"round(avg({c}), 6) AS {c}" for c in _ALL_SCORES)} FROM scored JOIN groups USING (template_key) GROUP BY 1""")  # fmt: skip
def group_affect_summary(spark, d):
    p = _scored(spark, d)
    g = op.popularity_groups(op.template_popularity(p), 15, min_posts(d)).select("template_key", "group")
    s = rel.score_summary(p.join(F.broadcast(g), "template_key"), "group", "template_key", ["score"], 4, _ALL_SCORES)  # thirty rows
    return s.select("group", "posts", "templates", "mean_score", "median_score", *(F.round(c, 6).alias(c) for c in _ALL_SCORES))


@query("representative_post", f"""WITH {PREPARED} SELECT template_key, key, round(score, 4) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY template_key ORDER BY score DESC, created_utc, key) AS place FROM prepared) WHERE place = 1""")  # fmt: skip
def representative_post(spark, d):
    return op.representative_post(_prepared(spark, d)).select("template_key", "key", _r("score", 4))


@query("top_n_per_group", f"""WITH {PREPARED} SELECT template_key, key, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY template_key ORDER BY score DESC, created_utc, key) AS place FROM prepared) WHERE place <= 3""")  # fmt: skip
def top_n_per_group(spark, d):
    return rel.top_n_per_group(_prepared(spark, d), ["template_key"], [F.desc("score"), F.col("created_utc"), F.col("key")], 3).select("template_key", "key", "place")


@query("dedupe_first", f"WITH {PREPARED} SELECT template_key, min(key) AS key FROM prepared GROUP BY 1")
def dedupe_first(spark, d):
    return rel.dedupe(_prepared(spark, d), ["template_key"], "key").select("template_key", "key")


@query("dedupe_last", f"WITH {PREPARED} SELECT template_key, max(key) AS key FROM prepared GROUP BY 1")
def dedupe_last(spark, d):
    return rel.dedupe(_prepared(spark, d), ["template_key"], "key", last=True).select("template_key", "key")


@query("label_frequency_summary", f"""WITH {PREPARED}, n AS (SELECT template_key, count(*) AS n FROM prepared GROUP BY 1)
    SELECT count(*) AS classes, median(n) AS median_size, count(*) FILTER (WHERE n >= 20) AS at_least_20, count(*) FILTER (WHERE n >= 50) AS at_least_50, count(*) FILTER (WHERE n >= 100) AS at_least_100 FROM n""")  # fmt: skip
def label_frequency_summary(spark, d):
    n = _prepared(spark, d).groupBy("template_key").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("classes"), F.median("n").alias("median_size"), *(F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in (20, 50, 100)))


@query("coverage_counts", f"""WITH {POSTS} SELECT count(*) AS total, count(*) FILTER (WHERE template_final = 'NO_TEMPLATE') AS sentinel, count(*) FILTER (WHERE template_final <> 'NO_TEMPLATE') AS labelled,
    round(count(*) FILTER (WHERE template_final <> 'NO_TEMPLATE') / count(*), 6) AS labelled_share FROM posts""")  # fmt: skip
def coverage_counts(spark, d):
    return rel.coverage_counts(posts(spark, d), "template_final")


@query("assert_unique_key", "WITH n AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, n FROM n WHERE n > 1")
def assert_unique_key(spark, d):
    return rel.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("semi_isin", f"WITH {PREPARED}{_POPULAR} SELECT key FROM prepared WHERE template_key IN (SELECT template_key FROM popular WHERE posts >= 100)")
def semi_isin(spark, d):
    p = _prepared(spark, d)
    return p.join(p.groupBy("template_key").count().where("count >= 100"), "template_key", "left_semi").select("key")


@query("anti_isin", f"WITH {PREPARED}{_POPULAR} SELECT key FROM prepared WHERE template_key NOT IN (SELECT template_key FROM popular WHERE posts >= 100)")
def anti_isin(spark, d):
    p = _prepared(spark, d)
    return p.join(p.groupBy("template_key").count().where("count >= 100"), "template_key", "left_anti").select("key")


@query("join_left_1to1", f"WITH {POSTS} SELECT key, template_final, l_linenumber AS line FROM posts LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON key = l_orderkey")
def join_left_1to1(spark, d):
    one = table(spark, d, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_linenumber").alias("line"))
    return rel.join_checked(posts(spark, d), one, "key").select("key", "template_final", "line")


@query("join_inner_cluster", f"WITH {PREPARED}{_POPULAR}{_GROUPS} SELECT \"group\", count(*) AS posts FROM prepared JOIN groups USING (template_key) GROUP BY 1")
def join_inner_cluster(spark, d):
    p = _prepared(spark, d)
    g = op.popularity_groups(op.template_popularity(p), 15, min_posts(d))
    return p.join(F.broadcast(g.select("template_key", "group")), "template_key").groupBy("group").agg(F.count("*").alias("posts"))


@query("map_lookup", f"WITH {PREPARED}{_DISPLAY} SELECT key, coalesce(CASE WHEN variants > 1 THEN template_display END, template_final) AS label FROM prepared JOIN display USING (template_key)")
def map_lookup(spark, d):
    p = _prepared(spark, d)
    names = op.display_label(p).where("variants > 1").select("template_key", F.col("template_display").alias("name"))
    return p.join(names, "template_key", "left").select("key", F.coalesce("name", "template_final").alias("label"))


@query("union_all_by_name", f"WITH {PREPARED} SELECT key, CASE WHEN year(created_utc) < 1995 THEN 'early' ELSE 'late' END AS part, CASE WHEN year(created_utc) < 1995 THEN round(score, 2) END AS score FROM prepared")
def union_all_by_name(spark, d):
    p = _prepared(spark, d)
    early = p.where("year < 1995").select("key", F.lit("early").alias("part"), F.round("score", 2).alias("score"))
    return early.unionByName(p.where("year >= 1995").select("key", F.lit("late").alias("part")), allowMissingColumns=True)


@query("union_distinct_keys", "SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer")
def union_distinct_keys(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key")).union(table(spark, d, "customer").select("c_custkey")).distinct()


@query("set_intersect", "SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key")).intersect(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("set_except", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key")).exceptAll(table(spark, d, "orders").select("o_custkey").distinct()).distinct()


@query("composition_share", f"""WITH {PREPARED}, c AS (SELECT template_key, year(created_utc) AS year, count(*) AS n FROM prepared GROUP BY 1, 2)
    SELECT template_key, CAST(year AS INTEGER) AS year, n, round(n / sum(n) OVER (PARTITION BY template_key), 6) AS share FROM c""")  # fmt: skip
def composition_share(spark, d):
    return rel.composition_share(_prepared(spark, d), "template_key", "year")


def _means_sql(columns, digits=6) -> str:
    return ", ".join(f"round(avg({c}), {digits}) AS {c}" for c in columns)


@query("monthly_features", f"WITH {_SCORED_POSTS} SELECT strftime(month, '%Y-%m-%d') AS month, count(*) AS posts, round(avg(score), 4) AS mean_score, {_means_sql(op.MONTHLY)} FROM scored GROUP BY 1")
def monthly_features(spark, d):
    m = op.monthly_features(_scored(spark, d))
    return m.select(_d("month"), "posts", F.round("mean_score", 4).alias("mean_score"), *(F.round(c, 6).alias(c) for c in op.MONTHLY))


@query("year_summary_by_cluster", f"""WITH {PREPARED}, f AS (SELECT template_key, min(year(created_utc)) AS y, count(*) AS n FROM prepared GROUP BY 1)
    SELECT CASE WHEN n >= 100 THEN 'large' ELSE 'small' END AS cluster, count(*) AS templates, round(avg(y), 6) AS mean_year, median(y) AS median_year, CAST(min(y) AS INTEGER) AS first_year, CAST(max(y) AS INTEGER) AS last_year, round(avg(2026 - y), 6) AS mean_age FROM f GROUP BY 1""")  # fmt: skip
def year_summary_by_cluster(spark, d):
    f = _prepared(spark, d).groupBy("template_key").agg(F.min("year").alias("y"), F.count("*").alias("n"))
    return f.groupBy(F.when(F.col("n") >= 100, "large").otherwise("small").alias("cluster")).agg(F.count("*").alias("templates"), F.round(F.avg("y"), 6).alias("mean_year"), F.median("y").alias("median_year"), F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.round(F.avg(2026 - F.col("y")), 6).alias("mean_age"))


@query("stratified_split", f"""WITH {PREPARED}, r AS (SELECT key, template_key, row_number() OVER (PARTITION BY template_key ORDER BY md5(key || '|42'), key) AS r, count(*) OVER (PARTITION BY template_key) AS n FROM prepared)
    SELECT key, template_key, CASE WHEN r <= least(greatest(round(n * 0.2), 1), n - 1) THEN 'test' ELSE 'train' END AS split, CAST(r % 5 AS INTEGER) AS fold FROM r""")  # fmt: skip
def stratified_split(spark, d):
    return od.stratified_split(_prepared(spark, d).select("key", "template_key"), "template_key", "key", 0.2, 42)


@query("stratified_sample_n", f"""WITH {PREPARED}, r AS (SELECT key, template_key, row_number() OVER (PARTITION BY template_key ORDER BY md5(key || '|42'), key) AS r, count(*) OVER (PARTITION BY template_key) AS own, count(*) OVER () AS total FROM prepared)
    SELECT key, template_key FROM r ORDER BY r > greatest(1, round(own * 500 / total)), r > 1, md5(key || '|42'), key LIMIT 500""")  # fmt: skip
def stratified_sample_n(spark, d):
    return od.stratified_sample(_prepared(spark, d).select("key", "template_key"), "template_key", "key", 500, 42)


@query("one_example_per_label", f"""WITH {PREPARED}, r AS (SELECT key, template_key, row_number() OVER (PARTITION BY template_key ORDER BY md5(key || '|42'), key) AS r FROM prepared)
    SELECT key, template_key FROM r WHERE r = 1 ORDER BY md5(template_key || '|42'), template_key LIMIT 50""")  # fmt: skip
def one_example_per_label(spark, d):
    return rel.one_per_label(_prepared(spark, d).select("key", "template_key"), "template_key", "key", 50, 42)


@query("fixed_split_pipeline", f"""WITH {PREPARED}, big AS (SELECT key, template_key FROM (SELECT *, count(*) OVER (PARTITION BY template_key) AS c FROM prepared WHERE template_key NOT LIKE 'machinery%') WHERE c >= 7), r AS (SELECT key, template_key, row_number() OVER (PARTITION BY template_key ORDER BY md5(key || '|42'), key) AS r, count(*) OVER (PARTITION BY template_key) AS n FROM big)
    SELECT key, template_key, CASE WHEN r <= least(greatest(round(n * 0.2), 1), n - 1) THEN 'test' ELSE 'train' END AS split, CAST(r % 5 AS INTEGER) AS fold FROM r""")  # fmt: skip
def fixed_split_pipeline(spark, d):
    p = _prepared(spark, d).select("key", "template_key").where("template_key NOT LIKE 'machinery%'")
    return od.stratified_split(rel.drop_small_classes(p, "template_key", 7), "template_key", "key", 0.2, 42)


@query("class_sizes", f"""WITH {PREPARED}, n AS (SELECT template_key, count(*) AS n FROM prepared GROUP BY 1)
    SELECT count(*) FILTER (WHERE n < 100) AS removed_classes, CAST(coalesce(sum(n) FILTER (WHERE n < 100), 0) AS BIGINT) AS removed_rows, count(*) FILTER (WHERE n >= 100) AS kept_classes FROM n""")  # fmt: skip
def class_sizes(spark, d):
    n = _prepared(spark, d).groupBy("template_key").agg(F.count("*").alias("n"))
    small = F.col("n") < 100
    return n.agg(F.count_if(small).alias("removed_classes"), F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("removed_rows"), F.count_if(~small).alias("kept_classes"))


@query("self_pairs_within_group", f"""WITH {PREPARED}{_POPULAR}{_GROUPS}
    SELECT a."group" AS "group", a.template_key AS a, b.template_key AS b FROM groups a JOIN groups b ON a."group" = b."group" AND a.template_key < b.template_key""")  # fmt: skip
def self_pairs_within_group(spark, d):
    g = op.popularity_groups(op.template_popularity(_prepared(spark, d)), 15, min_posts(d))
    return rel.pairs_within(g, "group", "template_key")


@query("class_ordered_output", f"""WITH {PREPARED}, y AS (SELECT template_key, CASE WHEN count(*) >= 110 THEN 'evergreen' WHEN count(*) >= 90 THEN 'faded' ELSE 'other' END AS class FROM prepared GROUP BY 1)
    SELECT class, count(*) AS templates, CAST(CASE class WHEN 'evergreen' THEN 1 WHEN 'faded' THEN 3 ELSE 6 END AS INTEGER) AS position FROM y GROUP BY 1""")  # fmt: skip
def class_ordered_output(spark, d):
    n = _prepared(spark, d).groupBy("template_key").count()
    c = n.groupBy(F.when(F.col("count") >= 110, "evergreen").when(F.col("count") >= 90, "faded").otherwise("other").alias("class")).agg(F.count("*").alias("templates"))
    return rel.class_order(c, "class").orderBy("position")
