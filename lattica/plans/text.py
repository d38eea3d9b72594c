"""Queries on tokens, keywords and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import popularity as pop
from ..operators import relational as rel
from ..operators import text as op
from .base import NAMES, TEXTS, query, table, texts

STOP = ("the", "and", "for", "that", "with", "der", "die", "und", "que", "les", "des")
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


def _tokens(c: str = "local_text"):
    return sc.tokenise_alnum(c, 3, STOP)


def _tok_sql(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({c}), '[A-Za-z0-9'']+'), lambda w: trim(w, '''')), lambda w: len(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({_STOP_SQL}))"


_ROWS = f"{TEXTS}, tok AS (SELECT key, class, topic, {_tok_sql('local_text')} AS t, {_tok_sql('global_text')} AS g FROM texts), ex AS (SELECT key, class, topic, unnest(t) AS token FROM tok)"


@query("tokenise_alnum", f"WITH {_ROWS} SELECT key, array_to_string(t, ' ') AS tokens FROM tok")
def tokenise_alnum(spark, d):
    return texts(spark, d).select("key", F.array_join(_tokens(), " ").alias("tokens"))


@query("tokenise_letters", f"WITH {TEXTS} SELECT key, array_to_string(list_filter(list_transform(regexp_extract_all(local_text, '[A-Za-z][A-Za-z0-9_''-]+'), lambda w: lower(w)), lambda w: len(w) >= 3 AND w NOT IN ({_STOP_SQL})), ' ') AS tokens FROM texts")
def tokenise_letters(spark, d):
    return texts(spark, d).select("key", F.array_join(sc.tokenise_letters("local_text", 3, STOP), " ").alias("tokens"))


@query("content_hash", f"WITH {TEXTS} SELECT key, sha1(local_text) AS hash FROM texts")
def content_hash(spark, d):
    return texts(spark, d).select("key", F.sha1("local_text").alias("hash"))


@query("token_stats", f"""WITH {_ROWS}, c AS (SELECT key, token, count(*) AS c FROM ex GROUP BY 1, 2), p AS (SELECT *, c / sum(c) OVER (PARTITION BY key) AS p FROM c),
    s AS (SELECT key, CAST(sum(c) AS BIGINT) AS tokens, count(*) AS "distinct", -sum(p * ln(p)) AS h, sum(p * p) AS hhi, max(p) AS top1 FROM p GROUP BY 1)
    SELECT t.key, coalesce(tokens, 0) AS tokens, coalesce("distinct", 0) AS "distinct", round(coalesce("distinct" / tokens, 0), 6) AS ttr, round(coalesce(CASE WHEN "distinct" > 1 THEN h / ln("distinct") ELSE 0 END, 0), 6) AS entropy_norm, round(coalesce(hhi, 0), 6) AS hhi, round(coalesce(top1, 0), 6) AS top1_share FROM tok t LEFT JOIN s USING (key)""")  # fmt: skip
def token_stats(spark, d):
    s = op.token_stats(texts(spark, d), "key", _tokens())
    return s.select("key", "tokens", "distinct", *(F.round(c, 6).alias(c) for c in ("ttr", "entropy_norm", "hhi", "top1_share")))


_PROFILE = f"""{_ROWS}, prof AS (SELECT class, token, n, n / sum(n) OVER (PARTITION BY class) AS share, CAST(row_number() OVER (PARTITION BY class ORDER BY n DESC, token) AS INTEGER) AS rank FROM (SELECT class, token, count(*) AS n FROM ex GROUP BY 1, 2))"""


@query("class_token_profile", f"WITH {_PROFILE} SELECT class, token, n, round(share, 6) AS share, rank FROM prof")
def class_token_profile(spark, d):
    return op.class_token_profile(texts(spark, d), "class", _tokens()).select("class", "token", "n", F.round("share", 6).alias("share"), "rank")


@query("word_freq", f"WITH {_ROWS} SELECT class, token, count(*) AS n FROM ex GROUP BY 1, 2")
def word_freq(spark, d):
    return op.exploded(texts(spark, d), ["class"], _tokens()).groupBy("class", "token").agg(F.count("*").alias("n"))


@query("pairwise_lexical_jsd", f"""WITH {_PROFILE}, g AS (SELECT a.class AS a, b.class AS b, t.token FROM (SELECT DISTINCT class FROM prof) a JOIN (SELECT DISTINCT class FROM prof) b ON a.class < b.class CROSS JOIN (SELECT DISTINCT token FROM prof) t),
    x AS (SELECT g.a, g.b, coalesce(p.share, 0) AS p, coalesce(q.share, 0) AS q, coalesce(p.rank <= 50 AND q.rank <= 50, false) AS s FROM g LEFT JOIN prof p ON p.class = g.a AND p.token = g.token LEFT JOIN prof q ON q.class = g.b AND q.token = g.token)
    SELECT a, b, round(sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0)), 6) AS distance, count(*) FILTER (WHERE s) AS shared FROM x GROUP BY 1, 2""")  # fmt: skip
def pairwise_lexical_jsd(spark, d):
    return op.pairwise_lexical_jsd(op.class_token_profile(texts(spark, d), "class", _tokens()), "class").select("a", "b", F.round("distance", 6).alias("distance"), "shared")


@query("topk_overlap", f"""WITH {_PROFILE}, t AS (SELECT class, list(token) AS t FROM prof WHERE rank <= 50 GROUP BY 1)
    SELECT a.class AS a, b.class AS b, CAST(len(list_intersect(a.t, b.t)) AS INTEGER) AS shared, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard, array_to_string(list_sort(list_intersect(a.t, b.t)), ' ') AS tokens FROM t a JOIN t b ON a.class < b.class""")  # fmt: skip
def topk_overlap(spark, d):
    o = op.topk_overlap(op.class_token_profile(texts(spark, d), "class", _tokens()), "class", 50)
    return o.select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"), "tokens")


def _tfidf_sql(source: str = "ex", key: str = "key") -> str:
    return f"""tf AS (SELECT {key} AS key, token, count(*) AS tf FROM {source} GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
    w0 AS (SELECT tf.key, tf.token, tf, tf * (ln((1.0 + nn.n) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (token), nn), w AS (SELECT key, token, tf, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM w0)"""


@query("tfidf_docs", f"WITH {_ROWS}, nn AS (SELECT count(*) AS n FROM texts), {_tfidf_sql()} SELECT key, token, tf, round(w, 6) AS w FROM w")
def tfidf_docs(spark, d):
    return op.tfidf(texts(spark, d), "key", _tokens()).select("key", "token", "tf", F.round("w", 6).alias("w"))


@query("ngram_terms", f"""WITH {_ROWS}, x AS (SELECT unnest(list_concat(g, list_transform(range(1, greatest(len(g), 1)), lambda i: g[i] || ' ' || g[i + 1]))) AS term FROM tok)
    SELECT term, count(*) AS n FROM x GROUP BY 1""")  # fmt: skip
def ngram_terms(spark, d):
    t = texts(spark, d).select(_tokens("global_text").alias("t"))
    return t.select(F.explode(op.ngram_terms(F.col("t"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("text_pair_cosine", f"""WITH {_ROWS}, sides AS (SELECT key * 2 AS id, unnest(g) AS token FROM tok UNION ALL SELECT key * 2 + 1, unnest(t) FROM tok), nn AS (SELECT 2 * count(*) AS n FROM texts), {_tfidf_sql('sides', 'id')},
    s AS (SELECT a.key // 2 AS key, sum(a.w * b.w) AS c FROM w a JOIN w b ON a.token = b.token AND a.key % 2 = 0 AND b.key = a.key + 1 GROUP BY 1)
    SELECT texts.key, round(coalesce(c, 0), 6) AS cosine FROM texts LEFT JOIN s USING (key)""")  # fmt: skip
def text_pair_cosine(spark, d):
    return op.text_pair_cosine(texts(spark, d), "key", _tokens("global_text"), _tokens()).select("key", F.round("cosine", 6).alias("cosine"))


@query("abstraction_metrics", """WITH x AS (SELECT vec_id AS key, abs(CAST(embedding[1] AS DOUBLE)) AS ol, abs(CAST(embedding[2] AS DOUBLE)) AS gl, abs(CAST(embedding[3] AS DOUBLE)) AS og FROM embeddings)
    SELECT key, round(1 - ol, 6) AS detachment, round(gl, 6) AS retention, round(og - ol, 6) AS gap, CASE WHEN ol >= 0.18 THEN 'origin-retaining reuse' WHEN gl >= ol AND gl >= 0.12 THEN 'structural abstraction' WHEN og >= 0.12 AND ol < 0.12 THEN 'origin-to-affordance shift' ELSE 'high local detachment' END AS class FROM x""")  # fmt: skip
def abstraction_metrics(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), *(F.abs(F.col("embedding")[i].cast("double")).alias(n) for i, n in enumerate(("ol", "gl", "og"))))
    ol, gl, og = (F.col(c) for c in ("ol", "gl", "og"))
    return e.select("key", F.round(1 - ol, 6).alias("detachment"), F.round(gl, 6).alias("retention"), F.round(og - ol, 6).alias("gap"), op.abstraction_class(ol, gl, og).alias("class"))


@query("topic_labels", f"""WITH {_ROWS}, ranked AS (SELECT key, topic, row_number() OVER (PARTITION BY topic ORDER BY key) AS r FROM texts), e AS (SELECT ex.key, ex.topic, token FROM ex JOIN ranked USING (key) WHERE r <= 400),
    f AS (SELECT topic, token FROM (SELECT topic, token, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, token) AS r FROM e GROUP BY 1, 2) WHERE r <= 1500), n AS (SELECT topic, count(*) AS n FROM ranked WHERE r <= 400 GROUP BY 1),
    tf AS (SELECT topic, key, token, count(*) AS tf FROM e GROUP BY 1, 2, 3), df AS (SELECT topic, token, count(*) AS df FROM tf GROUP BY 1, 2),
    w0 AS (SELECT topic, key, token, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (topic, token) JOIN n USING (topic) JOIN f USING (topic, token)),
    w AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY topic, key)) AS u FROM w0), s AS (SELECT topic, token, sum(u) AS weight FROM w GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, token) AS INTEGER) AS rank FROM s)
    SELECT topic, token, round(weight, 5) AS weight, rank FROM r WHERE rank <= 5""")  # fmt: skip
def topic_labels(spark, d):
    return op.topic_labels(texts(spark, d), "topic", "key", _tokens()).select("topic", "token", F.round("weight", 5).alias("weight"), "rank")


@query("class_keywords_tfidf", f"""WITH {_ROWS}, nn AS (SELECT count(*) AS n FROM texts), {_tfidf_sql()}, sz AS (SELECT class, count(*) AS docs FROM texts GROUP BY 1),
    c0 AS (SELECT class, token, sum(w) AS s, CAST(sum(tf) AS BIGINT) AS n FROM w JOIN texts USING (key) GROUP BY 1, 2), c1 AS (SELECT class, token, n, s / docs AS m FROM c0 JOIN sz USING (class)),
    c AS (SELECT class, token, n, m / sqrt(sum(m * m) OVER (PARTITION BY class)) AS m FROM c1),
    o AS (SELECT a.class, a.token, a.n, a.m, coalesce(max(b.m), 0) AS other FROM c a LEFT JOIN c b ON a.token = b.token AND a.class <> b.class GROUP BY 1, 2, 3, 4),
    r AS (SELECT class, token, n, (m - other) * ln(1 + n) AS weight FROM o WHERE m > other), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY class ORDER BY round(weight, 9) DESC, token) AS INTEGER) AS rank FROM r)
    SELECT class, token, n, round(weight, 6) AS weight, rank FROM q WHERE rank <= 20""")  # fmt: skip
def class_keywords_tfidf(spark, d):
    return op.class_keywords(texts(spark, d), "class", "key", _tokens()).select("class", "token", "n", F.round("weight", 6).alias("weight"), "rank")


@query("context_summary", f"""WITH {TEXTS}, x AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY probability DESC, key) AS place FROM texts WHERE trim(global_text) <> ''), u AS (SELECT topic, global_text, min(place) AS place FROM x GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY place) AS r FROM u), j AS (SELECT topic, string_agg(global_text, ' | ' ORDER BY r) AS texts FROM r WHERE r <= 3 GROUP BY 1)
    SELECT t.topic, count(DISTINCT class) AS keywords, count(*) AS posts, round(count(DISTINCT class) / count(*), 6) AS keywords_per_post, any_value(j.texts) AS texts FROM texts t LEFT JOIN j ON t.topic = j.topic GROUP BY 1""")  # fmt: skip
def context_summary(spark, d):
    s = pop.context_summary(texts(spark, d), "topic", "global_text", "probability", "key", "class")
    return s.select("topic", "keywords", "posts", F.round("keywords_per_post", 6).alias("keywords_per_post"), "texts")


@query("topic_examples", f"WITH {TEXTS} SELECT topic, key, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY probability DESC, key) AS r FROM texts WHERE topic <> -1) WHERE r <= 3")
def topic_examples(spark, d):
    return rel.top_n_per_group(texts(spark, d).where("topic <> -1"), ["topic"], [F.desc("probability"), F.col("key")], 3).select("topic", "key", "place")


@query("attach_topics", f"WITH {TEXTS} SELECT d.doc_id AS key, CASE WHEN topic <> -1 THEN topic END AS topic FROM documents d LEFT JOIN texts ON doc_id = key")
def attach_topics(spark, d):
    t = texts(spark, d).where("topic <> -1").select("key", "topic")
    return rel.join_checked(table(spark, d, "documents").select(F.col("doc_id").alias("key")), t, "key")


@query("keep_any_text", f"WITH {TEXTS} SELECT key FROM texts WHERE trim(coalesce(global_text, '')) <> '' OR trim(coalesce(local_text, '')) <> ''")
def keep_any_text(spark, d):
    return texts(spark, d).where(F.coalesce(sc.non_blank("global_text"), sc.non_blank("local_text")).isNotNull()).select("key")


@query("build_text", "SELECT doc_id AS key, concat_ws(' ', nullif(trim(source), ''), nullif(trim(lang), ''), nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' END), '')) AS t FROM documents")
def build_text(spark, d):
    blank = F.when(F.col("doc_id") % 3 == 0, "  ")
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), sc.build_text("source", "lang", blank).alias("t"))


_N = "SELECT DISTINCT p_name || '-' || p_type || ' & man_guy' AS s FROM part"


@query("norm_key_alnum", f"SELECT s, regexp_replace(lower(s), '[^a-z0-9]+', '', 'g') AS k FROM ({_N})")
def norm_key_alnum(spark, d):
    return _names(spark, d).select("s", sc.norm_key_alnum("s").alias("k"))


def _names(spark, d):
    return table(spark, d, "part").select(F.concat("p_name", F.lit("-"), "p_type", F.lit(" & man_guy")).alias("s")).distinct()


@query("norm_words", f"SELECT s, trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '[_-]', ' ', 'g'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM ({_N})")
def norm_words(spark, d):
    return _names(spark, d).select("s", sc.norm_words("s").alias("k"))


SYNONYMS_SQL = """regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(trim({s})), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '\\bman\\b', 'person', 'g'), '\\bguy\\b', 'person', 'g'), '\\bwoman\\b', 'person', 'g')"""


@query("norm_synonyms", f"""SELECT s, {SYNONYMS_SQL.format(s='s')} AS k FROM ({_N})""")
def norm_synonyms(spark, d):
    return _names(spark, d).select("s", sc.norm_synonyms("s").alias("k"))


@query("split_multi_value", "SELECT DISTINCT p_type, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(p_type, ' ', ' ; '), '[,;/]'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'nan'), '|') AS parts FROM part")
def split_multi_value(spark, d):
    t = F.replace(F.col("p_type"), F.lit(" "), F.lit(" ; "))
    return table(spark, d, "part").select("p_type", F.array_join(sc.split_multi_value(t), "|").alias("parts")).distinct()


@query("extract_year", "SELECT o_orderkey AS key, CAST(regexp_extract(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '[0-9]{4}') AS INTEGER) AS year FROM orders")
def extract_year(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), sc.extract_year(F.col("o_orderdate").cast("date").cast("string")).alias("year"))


@query("lag_years", "SELECT o_orderkey AS key, CAST(year(CAST(o_orderdate AS DATE)) - 1990 AS INTEGER) AS lag FROM orders")
def lag_years(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.year("o_orderdate") - 1990).alias("lag"))


def _rules_sql(text: str) -> str:
    out = ""
    for label, terms in sc.FUNCTION_RULES:
        out += f" WHEN {' OR '.join(f'contains({text}, {chr(39)}{t}{chr(39)})' for t in terms)} THEN '{label}'"
    return f"CASE{out} ELSE '{sc.DEFAULT_FUNCTION}' END"


@query("keyword_rules", f"SELECT s, {_rules_sql('lower(s)')} AS function FROM (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN p_name || ' chart' WHEN p_partkey % 5 = 1 THEN p_name || ' Reaction' ELSE p_name END AS s FROM part)")
def keyword_rules(spark, d):
    k = F.col("p_partkey") % 5
    s = F.when(k == 0, F.concat("p_name", F.lit(" chart"))).when(k == 1, F.concat("p_name", F.lit(" Reaction"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(s.alias("s")).distinct().select("s", sc.keyword_rules("s").alias("function"))


@query("safe_log1p", "SELECT c_custkey AS key, round(ln(1 + greatest(coalesce(c_acctbal, 0), 0)), 6) AS v FROM customer")
def safe_log1p(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.round(sc.safe_log1p("c_acctbal"), 6).alias("v"))


@query("bundle_key", "SELECT page_id, regexp_extract(list_last(string_split(url, '/')), '^(.*?)(\\.[^.]*)?$', 1) AS stem FROM pages")
def bundle_key(spark, d):
    return table(spark, d, "pages").select("page_id", sc.file_stem("url").alias("stem"))


@query("source_url_pick", """WITH x AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS bare FROM pages)
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://cdn.example/' || page_id || '.png' WHEN regexp_matches(host, '(^|\\.)example\\.com$') THEN 'https://img.example/' || list_last(string_split(bare, '/')) || '.jpg' END AS source FROM x""")  # fmt: skip
def source_url_pick(spark, d):
    image = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://cdn.example/"), F.col("page_id").cast("string"), F.lit(".png")))
    return table(spark, d, "pages").select("page_id", sc.source_url_pick(image, F.col("url"), "example.com", "https://img.example/").alias("source"))


@query("biography_lookup", f"WITH {NAMES} SELECT name, coalesce(CASE name WHEN (SELECT min(name) FROM names) THEN 'override' END, left(name, 280)) AS origin FROM names")
def biography_lookup(spark, d):
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    overrides = n.agg(F.min("name").alias("name")).withColumn("o", F.lit("override"))
    return n.join(F.broadcast(overrides), "name", "left").select("name", F.coalesce("o", F.substring("name", 1, 280)).alias("origin"))


@query("kb_match_coverage", "SELECT unnest(string_split(p_type, ' ')) AS origin, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS matched FROM part GROUP BY 1")
def kb_match_coverage(spark, d):
    p = table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("origin"), "p_size")
    return p.groupBy("origin").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("matched"))


@query("cache_lookup_missing", f"WITH {TEXTS}, u AS (SELECT DISTINCT sha1(global_text) AS hash, global_text FROM texts), c AS (SELECT DISTINCT sha1(global_text) AS hash, 1.0::DOUBLE AS score FROM texts WHERE key % 2 = 0) SELECT u.hash, coalesce(c.score, CAST(length(global_text) AS DOUBLE)) AS score FROM u LEFT JOIN c USING (hash)")
def cache_lookup_missing(spark, d):
    t = texts(spark, d)
    cache = t.where("key % 2 = 0").select(F.sha1("global_text").alias("hash"), F.lit(1.0).alias("score")).dropDuplicates(["hash"])
    return rel.missing_scored(t, cache, "global_text", F.length("t").cast("double"))


@query("bundle_outer_assemble", "SELECT coalesce(a.key, b.key) AS key, lang, quality FROM (SELECT doc_id AS key, lang FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT doc_id AS key, max(quality) AS quality FROM labels GROUP BY 1) b ON a.key = b.key")
def bundle_outer_assemble(spark, d):
    a = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), "lang")
    b = table(spark, d, "labels").groupBy(F.col("doc_id").alias("key")).agg(F.max("quality").alias("quality"))
    return rel.outer_assemble([a, b], "key").select("key", "lang", "quality")


@query("bundle_enrich_coverage", "SELECT count(*) AS total, count(quality) AS with_label, round(count(quality) / count(*), 6) AS share FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def bundle_enrich_coverage(spark, d):
    b = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    x = table(spark, d, "documents").select("doc_id").join(b, "doc_id", "left")
    return x.agg(F.count("*").alias("total"), F.count("quality").alias("with_label"), F.round(F.count("quality") / F.count("*"), 6).alias("share"))
