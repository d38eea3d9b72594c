"""Post tables, popularity of templates, and their gap-filled lifecycle series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import SENTINELS, calendar_parts, norm_key_alnum, safe_divide, safe_log1p
from .ordered import with_medians, with_pct_rank

DAY_SECONDS = 86400.0


def prepare_posts(posts: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """Posts with a time and a real template, with calendar parts, log score and score percentile in
    the month.  Optional columns keep their values; rows without a time or template go."""
    p = posts.where(F.col("created_utc").isNotNull() & F.col("template_final").isNotNull() & ~F.trim("template_final").isin(*sentinels))
    p = p.withColumns(calendar_parts("created_utc")).withColumns({"template_key": norm_key_alnum("template_final"), "log_score": safe_log1p("score")})
    return with_pct_rank(p, ["month"], "score", "month_score_pct")


def display_label(posts: DataFrame) -> DataFrame:
    """Most frequent spelling of every template key, the first in order on ties, and their number."""
    n = posts.groupBy("template_key", "template_final").agg(F.count("*").alias("n"))
    w = W.partitionBy("template_key").orderBy(F.desc("n"), "template_final")
    ranked = n.withColumn("r", F.row_number().over(w)).withColumn("variants", F.count("*").over(W.partitionBy("template_key")))
    return ranked.where("r = 1").select("template_key", F.col("template_final").alias("template_display"), "variants")


def template_popularity(posts: DataFrame) -> DataFrame:
    """Counts, times, scores, days and yearly rates of templates, ranked by posts."""
    end = posts.agg(F.max("created_utc").alias("dataset_end"))
    t = posts.groupBy("template_key").agg(F.count("*").alias("posts"), F.min("created_utc").alias("first_seen"), F.max("created_utc").alias("last_seen"), F.avg("score").alias("mean_score"))
    t = with_medians(t, posts, ["template_key"], ["score"])
    t = t.crossJoin(F.broadcast(end))  # one row

    def days(a: str, b: str, least: int) -> Column:
        return F.greatest(F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / DAY_SECONDS), F.lit(least)) + 1

    t = t.withColumn("observed_days", days("first_seen", "dataset_end", 1)).withColumn("active_days", days("first_seen", "last_seen", 0))
    t = t.withColumn("posts_per_observed_year", F.col("posts") * 365.25 / F.col("observed_days")).withColumn("posts_per_active_year", F.col("posts") * 365.25 / F.col("active_days"))
    order = W.orderBy(F.desc("posts"), F.desc("posts_per_observed_year"), "template_key")  # one row a template
    return t.withColumn("rank", F.row_number().over(order)).withColumn("dense_rank", F.dense_rank().over(W.orderBy(F.desc("posts")))).drop("dataset_end")


def eligible_templates(popularity: DataFrame, min_posts: int, min_days: int = 90) -> DataFrame:
    order = W.orderBy(F.desc("posts_per_observed_year"), "template_key")
    return popularity.where((F.col("posts") >= min_posts) & (F.col("observed_days") >= min_days)).withColumn("eligible_rank", F.row_number().over(order))


def spine(start: Column, end: Column, step: str) -> Column:
    return F.explode(F.sequence(start, end, F.expr(f"INTERVAL 1 {step}")))


def overall_volume(posts: DataFrame, freq: str = "month") -> DataFrame:
    """Posts per period, with 0 for periods in between that have none."""
    n = posts.groupBy(F.date_trunc(freq, "created_utc").alias("period")).agg(F.count("*").alias("posts"))
    every = n.agg(F.min("period").alias("a"), F.max("period").alias("b")).select(spine(F.col("a"), F.col("b"), freq).alias("period"))
    return every.join(n, "period", "left").select("period", F.coalesce("posts", F.lit(0)).alias("posts"))


def trailing(key: str, order: str, rows: int) -> W:
    return W.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0)


def lifecycle_curve(posts: DataFrame, freq: str = "month", smooth: int = 3) -> DataFrame:
    """Per template: posts of every period from its first one to the dataset's last one, their
    trailing mean, and that mean over its peak (1 at least); ``pos`` counts periods from 1."""
    n = posts.groupBy("template_key", F.date_trunc(freq, "created_utc").alias("period")).agg(F.count("*").alias("posts"))
    end = posts.agg(F.date_trunc(freq, F.max("created_utc")).alias("b"))
    starts = n.groupBy("template_key").agg(F.min("period").alias("a")).crossJoin(F.broadcast(end))
    every = starts.select("template_key", spine(F.col("a"), F.col("b"), freq).alias("period"))
    c = every.join(n, ["template_key", "period"], "left").withColumn("posts", F.coalesce("posts", F.lit(0)))
    c = c.withColumn("smooth", F.avg("posts").over(trailing("template_key", "period", smooth)))
    c = c.withColumn("smooth_norm", F.col("smooth") / F.greatest(F.max("smooth").over(W.partitionBy("template_key")), F.lit(1.0)))
    return c.withColumn("pos", F.row_number().over(W.partitionBy("template_key").orderBy("period")))


def lifecycle_events(curve: DataFrame, fraction: float = 0.5, sustain: int = 3, zero_run: int = 6) -> DataFrame:
    """First and peak period, decline start and expiry, and the number of periods.

    Peak: first maximum of the smoothed series.  Decline: first period that ends ``sustain`` periods
    after the peak at or below ``fraction`` of it.  Expiry: the same for ``zero_run`` empty periods.
    """
    key = W.partitionBy("template_key")
    c = curve.withColumn("peak", F.max(F.struct("smooth", (-F.col("pos")).alias("p"), "period")).over(key))
    c = c.withColumn("after", F.col("pos") > -F.col("peak.p"))
    low = F.when(F.col("after") & (F.col("smooth") <= fraction * F.col("peak.smooth")), 1).otherwise(0)
    zero = F.when(F.col("after") & (F.col("posts") == 0), 1).otherwise(0)
    c = c.withColumn("low", F.sum(low).over(trailing("template_key", "period", sustain))).withColumn("zero", F.sum(zero).over(trailing("template_key", "period", zero_run)))
    return c.groupBy("template_key").agg(
        F.min("period").alias("first_period"),
        F.first("peak.period").alias("peak_period"),
        F.min(F.when(F.col("low") == sustain, F.col("period"))).alias("decline_start"),
        F.min(F.when(F.col("zero") == zero_run, F.col("period"))).alias("expiry"),
        F.count_if(F.col("posts") > 0).alias("active_periods"),
        F.count("*").alias("observed_periods"),
    )


def runs_islands(curve: DataFrame, value: str = "posts", floor: float = 0.0) -> DataFrame:
    """Active runs, reactivations and the longest run without activity of every template's curve."""
    w = W.partitionBy("template_key").orderBy("pos")
    c = curve.withColumn("active", F.col(value) > floor)
    c = c.withColumn("start", (F.col("active") != F.coalesce(F.lag("active").over(w), ~F.col("active"))).cast("int"))
    runs = c.withColumn("run", F.sum("start").over(w)).groupBy("template_key", "run").agg(F.first("active").alias("active"), F.count("*").alias("n"))
    return runs.groupBy("template_key").agg(F.count_if("active").alias("active_runs"), F.greatest(F.count_if("active") - 1, F.lit(0)).alias("reactivations"), F.coalesce(F.max(F.when(~F.col("active"), F.col("n"))), F.lit(0)).alias("longest_zero_run"))


def lifecycle_features(curve: DataFrame, value: str = "posts", floor: float = 0.0) -> DataFrame:
    """Shape measures of every template's curve; ``floor`` is what a period needs to be active."""
    key = W.partitionBy("template_key")
    order = key.orderBy("pos")
    v, total, n, active = F.col(value).cast("double"), F.col("total"), F.col("n"), F.col("active")
    c = curve.select("template_key", "period", "pos", v.alias("v"))
    v = F.col("v")
    c = c.withColumns({"total": F.sum("v").over(key), "n": F.count("*").over(key), "active": v > floor, "cumulative": F.sum("v").over(order), "place": F.row_number().over(key.orderBy(F.desc("v"), "pos")), "peak_pos": F.min_by("pos", F.struct(-v, "pos")).over(key), "peak": F.max("v").over(key)})
    p, recent = v / F.greatest(total, F.lit(1.0)), F.least(n, F.lit(3))
    after = F.col("pos") > F.col("peak_pos")
    f = c.groupBy("template_key").agg(
        F.first("total").alias("total"), F.first("n").alias("observed_periods"), F.count_if(active).alias("active_periods"), F.first("peak").alias("peak_count"), F.first("peak_pos").alias("peak_pos"),
        F.sum(F.when(F.col("place") <= 3, v)).alias("top3"), F.coalesce(F.median(F.when(active, v)), F.lit(0.0)).alias("median_active"), F.coalesce(F.avg(F.when(active, v)), F.lit(0.0)).alias("mean_active"),
        F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).alias("entropy"), F.sum(p * p).alias("hhi"),
        F.sum(F.when(after, v).otherwise(0.0)).alias("after_peak"), F.count_if(after & active).alias("after_active"), F.count_if(after).alias("after_periods"), F.sum(F.when(F.col("pos") < F.col("peak_pos"), v).otherwise(0.0)).alias("before_peak"),
        F.min(F.when(F.col("cumulative") >= 0.5 * total, F.col("pos"))).alias("periods_to_half"),
        F.sum(F.when(F.col("pos") > n - recent, v).otherwise(0.0)).alias("recent"), F.sum(F.when((F.col("pos") <= n - recent) & (F.col("pos") > n - 2 * recent), v).otherwise(0.0)).alias("previous"),
        F.coalesce(F.regr_slope(F.when(F.col("pos") > n - 6, p), F.col("pos").cast("double")), F.lit(0.0)).alias("recent_slope"),
    )
    f = f.join(runs_islands(c.withColumnRenamed("v", "x"), "x", floor), "template_key")
    total, n = F.col("total"), F.col("observed_periods")
    peak_share, top3 = safe_divide(F.col("peak_count"), total), safe_divide(F.col("top3"), total)
    to_median = F.col("peak_count") / F.greatest("median_active", F.lit(1.0))
    age = (n - F.col("peak_pos")) / F.greatest(n - 1, F.lit(1))
    return f.select(
        "template_key", total.alias("total_posts"), "observed_periods", "active_periods", (F.col("active_periods") / n).alias("active_ratio"), "peak_count", peak_share.alias("peak_share"), top3.alias("top3_share"), to_median.alias("peak_to_median_active"), F.log1p(to_median).alias("peak_to_median_active_log"), (F.col("peak_count") / F.greatest("mean_active", F.lit(1.0))).alias("peak_to_mean_active"),
        F.when(n > 1, F.col("entropy") / F.log(n)).otherwise(0.0).alias("entropy_norm"), "hhi", "active_runs", (F.col("active_runs") / n).alias("active_run_density"), "reactivations", (F.col("reactivations") / F.greatest("active_runs", F.lit(1))).alias("reactivation_ratio"), "longest_zero_run", (F.col("longest_zero_run") / n).alias("longest_zero_ratio"),
        safe_divide(F.col("after_peak"), total).alias("post_peak_share"), safe_divide(F.col("after_active"), F.col("after_periods")).alias("post_peak_active_ratio"), safe_divide(F.col("before_peak"), total).alias("pre_peak_share"), "periods_to_half", (F.col("periods_to_half") / n).alias("half_ratio"), age.alias("peak_age_ratio"), (1 - age).alias("peak_recency_ratio"),
        safe_divide(F.col("recent"), total).alias("recent_share_3"), F.when(n > 3, safe_divide(F.col("previous"), total)).otherwise(0.0).alias("previous_share_3"), F.log((F.col("recent") + 1) / (F.when(n > 3, F.col("previous")).otherwise(0.0) + 1)).alias("recent_growth_log"), "recent_slope", (peak_share + top3 + F.log1p(to_median)).alias("virality_index"),
    )


def curve_matrix(posts: DataFrame, templates: DataFrame, freq: str = "month", smooth: int = 3, norm: str = "max") -> DataFrame:
    """Long (template_key, period, value) of the given templates over the whole dataset's span:
    trailing means over their maximum, their sum, or as they are."""
    n = posts.groupBy("template_key", F.date_trunc(freq, "created_utc").alias("period")).agg(F.count("*").alias("posts"))
    every = posts.agg(F.date_trunc(freq, F.min("created_utc")).alias("a"), F.date_trunc(freq, F.max("created_utc")).alias("b")).select(spine(F.col("a"), F.col("b"), freq).alias("period"))
    grid = templates.select("template_key").crossJoin(F.broadcast(every))  # periods of one calendar, not of the data's rows
    c = grid.join(n, ["template_key", "period"], "left").withColumn("smooth", F.avg(F.coalesce("posts", F.lit(0))).over(trailing("template_key", "period", smooth)))
    whole = W.partitionBy("template_key")
    by = {"max": F.max("smooth").over(whole), "total": F.sum("smooth").over(whole), "none": F.lit(1.0)}[norm]
    return c.select("template_key", "period", safe_divide(F.col("smooth"), by).alias("value"))


def popularity_groups(popularity: DataFrame, n: int, floor: int) -> DataFrame:
    """The n templates with most posts and the n with fewest above a floor; a template in both is unpopular."""
    p = popularity.where(F.col("posts") >= floor)
    p = p.withColumn("top", F.row_number().over(W.orderBy(F.desc("posts"), "template_key"))).withColumn("low", F.row_number().over(W.orderBy("posts", "template_key")))
    return p.select("template_key", "posts", F.when(F.col("low") <= n, "unpopular").when(F.col("top") <= n, "popular").alias("group")).where("group is not null")


def representative_post(posts: DataFrame, n: int = 1) -> DataFrame:
    w = W.partitionBy("template_key").orderBy(F.desc_nulls_last("score"), "created_utc", "key")
    return posts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def context_summary(rows: DataFrame, key: str, text: str, score: str, time: str, keyword: str, m: int = 3) -> DataFrame:
    """Per key the first m distinct non-blank texts by falling score and rising time, joined, and the
    number of distinct keywords, in all and for each post."""
    w = W.partitionBy(key).orderBy(F.desc_nulls_last(score), time)
    ranked = rows.where(F.trim(text) != "").withColumn("place", F.row_number().over(w)).groupBy(key, text).agg(F.min("place").alias("place"))
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("place"))).where(F.col("r") <= m)
    first = ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text))), lambda x: x[text]), " | ").alias("texts"))
    words = rows.groupBy(key).agg(F.count_distinct(keyword).alias("keywords"), F.count("*").alias("posts"))
    return words.join(first, key, "left").withColumn("keywords_per_post", F.col("keywords") / F.col("posts"))


BALANCES = ("global_sentiment_balance", "local_sentiment_balance")
#: Balances, and the emotions whose means describe a month.
MONTHLY = (*BALANCES, *(f"{k}_{c}" for c in ("global", "local") for k in ("joy", "anger", "sadness", "disgust", "optimism", "fear")))


def with_balances(posts: DataFrame) -> DataFrame:
    """positive - negative of both contexts; null where one is."""
    return posts.withColumns({f"{c}_sentiment_balance": F.col(f"positive_{c}") - F.col(f"negative_{c}") for c in ("global", "local")})


def monthly_features(posts: DataFrame) -> DataFrame:
    """Posts, mean score, mean balances and mean emotions of every month."""
    return posts.groupBy("month").agg(F.count("*").alias("posts"), F.avg("score").alias("mean_score"), *(F.avg(c).alias(c) for c in MONTHLY))
