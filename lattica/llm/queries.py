"""Queries over the operators of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import duplicate_groups
from .filter_audit import filter_audit
from .first_fit import pack_first_fit
from .maxscore import top_k
from .mixing import mix
from .ngram_join import ngram_components
from .packing import pack_documents
from .page_diff import main_text
from .pseudonyms import pseudonymise
from .quality import score_quality
from .suffix_dedup import repeated_spans
from .vector_codes import encode_vectors
from .warc import deduplicated_archives


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The tokenizer file of the packing query; every executor has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    """The tokenizer file of the first-fit query; every executor has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pseudonym_key(spark: SparkSession) -> str:
    """The session's key in spark.lattica.pseudonymKey; where it is unset, a random one for the session."""
    key = spark.conf.get("spark.lattica.pseudonymKey", None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set("spark.lattica.pseudonymKey", key)
    return key


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(_read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_archives(_read(spark, sf_dir, "pages"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_read(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), word_tokenizer())


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_read(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_read(spark, sf_dir, "documents"), pseudonym_key(spark))


def op11_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_first_fit(_read(spark, sf_dir, "documents"), byte_tokenizer())


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(_read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


SQL = {
    "op2_maxscore": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        x AS (SELECT page_id, h, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS original FROM p),
        b AS (
            SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
                    CAST(('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5)) AS BIGINT) // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32, 1)), 'string_agg', '') AS payload_digest
            FROM x)
        SELECT page_id, octet_length(encode(h)) AS payload_bytes, payload_digest,
               CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> original THEN original END AS refers_to
        FROM b""",
    "op10_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(coalesce(text, '')) AS h FROM documents),
        b AS (  -- parts of 500 places, as a place is found by counting from its string's start
            SELECT row, doc_id, k, n, substr(h, CAST(1000 * k + 1 AS BIGINT), 1098) AS part
            FROM (SELECT row, doc_id, h, len(h) // 2 - 49 AS n, unnest(range(0, CAST(len(h) // 1000 + 1 AS BIGINT))) AS k FROM d WHERE doc_id IS NOT NULL)
            WHERE n > 500 * k),
        w AS (
            SELECT row, doc_id, 500 * k + i AS p, substr(part, CAST(2 * i + 1 AS BIGINT), 100) AS s
            FROM (SELECT *, unnest(range(0, CAST(least(500, n - 500 * k) AS BIGINT))) AS i FROM b)),
        f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY 1),
        g AS (SELECT row, p, p > lag(p, 1, -51) OVER (PARTITION BY row ORDER BY p) + 50 AS head FROM w JOIN f USING (s) WHERE m < doc_id),
        n AS (SELECT row, p, sum(CAST(head AS INTEGER)) OVER (PARTITION BY row ORDER BY p) AS span FROM g),
        r AS (SELECT row, span, min(p) AS lo, max(p) + 50 AS hi FROM n GROUP BY 1, 2),
        k AS (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY row ORDER BY lo) AS upto FROM r),
        a AS (
            SELECT row, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS last,
                   string_agg(substr(h, CAST(2 * upto + 1 AS BIGINT), CAST(2 * (lo - upto) AS BIGINT)), '' ORDER BY lo) AS kept
            FROM k JOIN d USING (row) GROUP BY 1)
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
        FROM d LEFT JOIN a USING (row)""",
    "op8_ngram_join": """
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        g AS (
            SELECT doc_id, unnest(list_distinct(CASE
                WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
            FROM t),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) r ON r.id = d.doc_id""",
    "op12_vector_codes": """
        WITH k AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
        p AS (SELECT row, part, v[len(v) * part // 16 + 1 : len(v) * (part + 1) // 16] AS x FROM k, (SELECT unnest(range(16)) AS part)),
        c0 AS (SELECT part, row - 1 AS e, x AS c FROM p WHERE row <= 64),
        a0 AS (SELECT row, part, any_value(x) AS x, min((d, e)) AS m FROM (
            SELECT row, p.part, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c0 USING (part)) GROUP BY 1, 2),
        s0 AS (SELECT part, e, list(m ORDER BY i) AS c FROM (
            SELECT part, e, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS m
            FROM (SELECT part, m[2] AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a0) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        c1 AS (SELECT part, e, coalesce(s0.c, c0.c) AS c FROM c0 LEFT JOIN s0 USING (part, e)),
        a1 AS (SELECT row, part, any_value(x) AS x, min((d, e)) AS m FROM (
            SELECT row, p.part, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c1 USING (part)) GROUP BY 1, 2),
        s1 AS (SELECT part, e, list(m ORDER BY i) AS c FROM (
            SELECT part, e, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS m
            FROM (SELECT part, m[2] AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a1) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        c2 AS (SELECT part, e, coalesce(s1.c, c1.c) AS c FROM c1 LEFT JOIN s1 USING (part, e)),
        a2 AS (SELECT row, part, min((d, e)) AS m FROM (
            SELECT row, p.part, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c2 USING (part)) GROUP BY 1, 2),
        o AS (SELECT row, string_agg(printf('%02x', m[2]), '' ORDER BY part) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a2 GROUP BY 1),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM k JOIN o USING (row), h""",
    "op13_filter_audit": """
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
        l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
        f AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
                'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
                'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
                'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(first < doc_id, false)} AS fails
            FROM w LEFT JOIN l USING (doc_id)),
        m AS (SELECT part, concat_ws('', CASE WHEN fails.A THEN 'A' END, CASE WHEN fails.B THEN 'B' END, CASE WHEN fails.C THEN 'C' END,
                     CASE WHEN fails.D THEN 'D' END, CASE WHEN fails.E THEN 'E' END) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
              FROM f GROUP BY 1, 2),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
              WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before
              FROM o, (SELECT unnest(range(1, 6)) AS step)),
        r AS (
            SELECT part, filter_order, step, filter, n, good, toxic, fails,
                   contains(fails, filter) AS own, fails <> '' AND before <> '' AND translate(fails, before, '') <> fails AS earlier
            FROM m, s),
        g AS (
            SELECT part, filter_order, step, filter,
                   coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT earlier), 0) AS removed,
                   coalesce(sum(n) FILTER (own AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (own AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT earlier), 0) AS toxic_lost
            FROM r GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
        FROM g""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_maxscore": op2_maxscore,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_main_text": op6_main_text,
    "op7_packing": op7_packing,
    "op8_ngram_join": op8_ngram_join,
    "op9_mixing": op9_mixing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_first_fit": op11_first_fit,
    "op12_vector_codes": op12_vector_codes,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}
