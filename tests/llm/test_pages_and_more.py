"""Archives, pages, search, pseudonyms and the pipeline against plain versions."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import maxscore, mixing, ngram_join, page_diff, pseudonyms, quality, warc

MENU = "<nav><a href='/'>Home</a></nav>"
PAGES = [
    (1, "http://h.example/a/1", f"<html><head><title>T</title></head><body>{MENU}<div>Site name</div><p>First &amp; only</p><p>text  one<br>more</p><div>Legal line</div></body></html>"),
    (2, "http://h.example/a/2", f"<body>{MENU}<div>Site name</div><p>Second text</p><div>Legal line</div><div class='comments'>me too</div>"),
    (3, "http://other.example/x", "<article><h1>Head</h1><p>Body<script>no()</script><div class=\"ad\">buy</div></article><footer>f</footer>"),
    (4, "http://other.example/y", "<article><h1>Head</h1><p>Body<aside>no</aside></article>"),
    (5, None, None),
    (6, "", ""),
    (7, "http://z.example/", "plain < text > é"),
    (8, "http://z.example/\r\nX: y", "plain < text > é"),
    (None, "http://n.example/", "null id"),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for name in ("digest", "original", "version", "lines", "part", "extra", "text", "host"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def test_archives_round_trip(spark, pages, tmp_path):
    got = {r.page_id: r for r in warc.deduplicated_archives(pages, path=str(tmp_path / "w")).collect()}
    largest = defaultdict(list)
    for i, _, h in PAGES:
        largest[h or ""].append(i)
    for i, _, h in PAGES:
        b = (h or "").encode()
        keep = max((x for x in largest[h or ""] if x is not None), default=None)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if keep == i else ("revisit", keep))
    back = warc.read_archives(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()
    assert all(r.payload == next(h or "" for i, _, h in PAGES if i == r.page_id) for r in back)


@pytest.mark.parametrize("few", [0, warc.FEW])
def test_archives_of_hot_payloads(spark, few):
    """A third of all pages hold one payload, some rows are repeated, and a payload looks like a record."""
    odd = "x\r\n\r\nWARC/1.1\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(i, f"http://h.example/{i}", "same" if i % 3 == 0 else odd if i % 50 == 1 else f"page {i} é" * 5) for i in range(300)]
    rows += [(297, "http://h.example/297", "same")] * 3 + [(5, "http://h.example/5", rows[5][2])] * 2 + [(None, "n", "none")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.resolve(df, few=few)
    assert len({(r.page_id, r.digest, r["copy"]) for r in got.select("page_id", "digest", "copy").collect()}) == len(rows)
    answers = [(r.page_id, r.original) for r in got.select("page_id", "original").collect()]
    same = [(i, x) for i, x in answers if i is not None and i % 3 == 0]
    assert sum(x is None for _, x in same) == 1 and {x for _, x in same} == {None, 297} and (297, None) in same
    assert sorted(str(x) for i, x in answers if i == 5) == ["5", "5", "None"] and [x for i, x in answers if i is None] == [None, None]
    back = warc.deduplicated_archives(df).collect()
    assert Counter((r.page_id, r.refers_to) for r in back) == Counter(answers)
    size = {(i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows}
    assert all((r.page_id, r.payload_bytes, r.payload_digest) in size for r in back)
    assert warc.deduplicated_archives(df.where("false")).count() == 0


def test_small_payloads_stay_responses(spark, pages, tmp_path):
    got = warc.deduplicated_archives(pages, min_bytes=10**6, path=str(tmp_path / "w")).collect()
    assert {r.record_type for r in got} == {"response"} and len(got) == len(PAGES)


def test_main_text(pages):
    got = {r.page_id: r.text for r in page_diff.main_text(pages).collect()}
    assert page_diff.main_text(pages.where("false")).count() == 0
    assert got == {1: "First & only\n\ntext one more", 2: "Second text", 3: "Head\n\nBody", 4: "Head\n\nBody", 5: "", 6: "", 7: "plain < text > é", 8: "plain < text > é", None: "null id"}


def test_differencing_judges_pages_with_a_marked_part(spark):
    """Markup keeps shared lines of its element; it does not decide on the lines outside of it."""
    teaser = "<article><p>Read this too</p></article>"
    rows = [(i, f"http://h.example/b/{i}", f"<body>{MENU}<div>Site name</div><p>Text {i}</p><p>More {i}</p>{teaser}<div>Legal line</div></body>") for i in (1, 2)]
    rows.append((3, "http://h.example/c", f"<body><div>Site name</div>{teaser}<div>Legal line</div></body>"))
    got = {r.page_id: r.text for r in page_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Text 1\n\nMore 1\n\nRead this too", 2: "Text 2\n\nMore 2\n\nRead this too", 3: "Read this too"}


def test_blocks_of_an_article():
    lines = page_diff.page_lines("<div class='byline'>out</div><article><p class='byline'>By A</p><div class='alert'>Mind</div><div class='promo'>no</div><p>Text</p></article><div class='alert'>out</div>")
    assert lines == [("By A", 2), ("Mind", 2), ("Text", 2)]


def test_nearest_pairs(spark):
    """Pairs over many range partitions, with equal paths and a host of most pages, against sorting."""
    r = np.random.default_rng(6)
    rows = [("big" if r.random() < 0.8 else f"h{r.integers(0, 30)}", "/" + "".join(r.choice(list("ab/é"), r.integers(0, 6))), int(r.integers(0, 150)), i) for i in range(300)]
    df = spark.createDataFrame([(*x, [x[3]]) for x in rows], "host string, path string, page_id long, version long, hashes array<long>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {(x.page_id, x.version): x.near[0] for x in page_diff.nearest_pairs(df.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    rows.sort(key=lambda x: (x[0].encode(), x[1].encode(), x[2], x[3]))
    want = {}
    for i, (host, path, page, version) in enumerate(rows):
        near = [(-common(path, o[1]), j, o[3]) for j, o in ((k, rows[k]) for k in (i - 1, i + 1) if 0 <= k < len(rows)) if o[0] == host]
        if near:
            want[page, version] = min(near)[2]
    assert got == want


def test_shared_lines_is_a_longest_common_subsequence():
    r = np.random.default_rng(5)
    for _ in range(40):
        a, b = r.integers(0, 6, r.integers(0, 25)).tolist(), r.integers(0, 6, r.integers(0, 25)).tolist()
        c = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                c[i + 1, j + 1] = c[i, j] + 1 if x == y else max(c[i, j + 1], c[i + 1, j])
        got = page_diff.shared_lines(a, b)
        assert len(got) == c[-1, -1]
        at = 0
        for i in got:
            at = b.index(a[i], at) + 1


def test_search(spark):
    r = np.random.default_rng(7)
    v = r.normal(size=(300, 16)) * r.choice([0, 1], (300, 16))
    v[120] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (950, [float("nan")] * 16), (1000, [1.0, None]), (1050, [0.5, 0.25]), (None, [1.0] * 16), (7, v[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    good = [(i, np.floor(256 * np.array(x + [0.0] * (16 - len(x)))).astype(int)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    want = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        x = next(a for i, a in good if i == q)
        best = sorted(((-int(x @ a), i) for i, a in good if i != q))[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.top_k(df).collect())
    assert got == sorted(want)
    assert maxscore.top_k(df.where("false")).count() == 0


def test_search_of_many_shards_and_large_numbers(spark):
    """Shards of 40 rows, components beyond 2**40 and of 1e300, and one row repeated 90 times."""
    r = np.random.default_rng(11)
    rows = [(i, (r.normal(size=8) * (2.0**41 if i % 37 == 0 else 1)).tolist()) for i in range(400)]
    rows += [(401, [1e300] * 8), (402, [-1e300] + [0.0] * 7), (403, [])] + [(77, rows[77][1])] * 90
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(x) * 256 if abs(x) > 1e290 else int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for q in range(0, 400, 50):
        x = dict(whole)[q]
        best = sorted((-min(max(sum(a * b for a, b in zip(x, v)), -(2**63)), 2**63 - 1), i) for i, v in whole if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in maxscore.top_k(df, shard=40).collect())
    assert got == sorted(want)


TEXTS = ["card 4532 0151 1283 0366, 4532015112830366 and 4532015112830367", "ip 10.1.2.3. then 999.1.2.3", "+1 (988) 555-2485 or 988-555-2485", "ssn 123-45-6789 not 000-12-3456", "2024-02-29 29/02/2024 29.02.2024 2023-02-29", "+49 30 1234567", " odd  10.1.2.3", None, "", "v1.2.3.4.5"]


def test_pseudonyms(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("parts", F.lit("x"))
    out = pseudonyms.pseudonymise(df, "k")
    new = {r.doc_id: r.text for r in out.collect()}
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(out, "k", inverse=True).collect()}
    assert back == dict(enumerate(TEXTS))
    spaced, plain, bad = new[0].split(" ", 1)[1].replace(" and ", ", ").split(", ")
    assert spaced.replace(" ", "") == plain != "4532015112830366" and bad == "4532015112830367"
    assert sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(plain[::-1])) % 10 == 0
    assert "10.1.2.3" not in new[1] + new[6] and "999.1.2.3" in new[1]
    assert new[1].split(" ")[1].rstrip(".") in new[6]
    a, b = new[2].split(" or ")
    assert "".join(c for c in a if c.isdigit())[1:] == "".join(c for c in b if c.isdigit())
    assert new[3].endswith("000-12-3456") and new[4].endswith("2023-02-29") and new[9] == TEXTS[9]
    y, m, d = new[4].split(" ")[0].split("-")
    assert new[4].split(" ")[1] == f"{d}/{m}/{y}" and new[4].split(" ")[2] == f"{d}.{m}.{y}"
    assert pseudonyms.pseudonymise(df.where("false"), "k").count() == 0


def test_pseudonyms_of_every_day(spark):
    """In a writing the pseudonyms of all its days are those days, and can be undone: all days of the
    shortest writing, and a tenth of those of the others."""
    day = F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int"))
    d, m, y = F.day(day).cast("string"), F.month(day).cast("string"), F.date_format(day, "yyyy")
    dd, mm = F.lpad(d, 2, "0"), F.lpad(m, 2, "0")
    writings = {
        "iso": F.when(F.col("id") % 10 == 0, F.date_format(day, "yyyy-MM-dd")),
        "padded": F.when(F.col("id") % 10 == 0, F.concat_ws("/", dd, mm, y)),
        "short": F.when((F.length(d) == 1) & (F.length(m) == 1), F.concat_ws("/", d, m, y)),
        "short day": F.when((F.length(d) == 1) & (F.col("id") % 10 == 0), F.concat_ws(".", d, mm, y)),
        "short month": F.when((F.length(m) == 1) & (F.col("id") % 10 == 0), F.concat_ws(".", dd, m, y)),
        "month first": F.when((F.day(day) > 12) & (F.col("id") % 10 == 0), F.concat_ws("/", mm, dd, y)),
        "short month first": F.when((F.day(day) > 12) & (F.length(m) == 1) & (F.col("id") % 10 == 0), F.concat_ws("/", m, dd, y)),
    }
    days = spark.range(0, 146_097, 1, 8).select("id", F.explode(F.map_from_arrays(F.array(*map(F.lit, writings)), F.array(*writings.values()))).alias("doc", "text")).where("text is not null")
    days = days.select(F.col("id").alias("doc_id"), F.concat("text", F.lit(" was the day")).alias("text"), F.col("doc").alias("writing"))
    joined = days.groupBy("writing", F.floor(F.col("doc_id") / 40)).agg(F.array_join(F.collect_list("text"), "\n").alias("text")).withColumn("doc_id", F.xxhash64("text"))
    out = pseudonyms.pseudonymise(joined, "k")
    back = pseudonyms.pseudonymise(out, "k", inverse=True)
    old, new, again = ({r.doc_id: r.text for r in x.collect()} for x in (joined, out, back))
    assert again == old
    seen = defaultdict(lambda: ([], []))
    for r in joined.select("doc_id", "writing").collect():
        seen[r.writing][0].extend(old[r.doc_id].split("\n"))
        seen[r.writing][1].extend(new[r.doc_id].split("\n"))
    assert len(seen) == len(writings)
    for writing, (values, others) in seen.items():
        assert len(set(others)) == len(others) and (writing != "short" or sorted(values) == sorted(others))


def test_pseudonyms_of_addresses(spark):
    """Different addresses stay different, case and shape stay, and all can be undone."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    local = [a + b for a in letters for b in letters] + ["Ann.Lee", "ann.lee", "ANN.LEE", "x", "7", "a1", "_", "long.name" * 7 + "9", "q" * 41]
    texts = [f"to {x}@mail.example.org, or" for x in local]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pseudonyms.pseudonymise(df, "k")
    new = {r.doc_id: r.text for r in out.collect()}
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymise(out, "k", inverse=True).collect()} == dict(enumerate(texts))
    assert len(set(new.values())) == len(texts)
    shape = lambda t: "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in t)
    assert all(shape(new[i]) == shape(t) for i, t in enumerate(texts))
    ann = [new[len(letters) ** 2 + i] for i in range(3)]
    assert len({x.lower() for x in ann}) == 1 and "ann" not in ann[1]


def test_pseudonyms_of_numbers(spark):
    """Phone numbers, addresses, security and card numbers: one to one, undone by the inverse."""
    r = np.random.default_rng(4)

    def digits(n):
        return "".join(map(str, r.integers(0, 10, n)))

    values = {f"{r.integers(2, 10)}{digits(2)}-{digits(3)}-{digits(4)}" for _ in range(300)} | {f"({r.integers(2, 10)}{digits(2)}) {digits(3)}-{digits(4)}" for _ in range(300)}
    values |= {f"+1 {digits(3)} {digits(3)} {digits(4)}" for _ in range(300)} | {f"+{r.integers(20, 99)} {digits(3)} {digits(5)}" for _ in range(300)}
    values |= {".".join(map(str, r.integers(0, 300, 4))) for _ in range(500)} | {f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(500)}
    values |= {digits(n) for n in range(13, 20) for _ in range(200)} | {f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}" for _ in range(500)}
    rows = list(enumerate(sorted(values)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pseudonyms.pseudonymise(df, "k")
    new = {x.doc_id: x.text for x in out.collect()}
    assert len(set(new.values())) == len(rows)
    assert {x.doc_id: x.text for x in pseudonyms.pseudonymise(out, "k", inverse=True).collect()} == dict(rows)


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(35).select((F.col("id") % 7).alias("x"), F.floor(F.col("id") / 7).alias("y"))
    p = pairs.select(pseudonyms.feistel("k")("t", F.col("x"), F.col("y"), 7, 5).alias("p")).collect()
    assert len({(r.p.x, r.p.y) for r in p}) == 35 and all(0 <= r.p.x < 7 and 0 <= r.p.y < 5 for r in p)


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), before.schema)
        assert docs.columns == before.columns
        if name == "exact_copies":
            assert docs.select("text").distinct().count() == docs.count() == before.select("text").distinct().count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect())


def test_pipeline_of_odd_rows(spark, docs, rows, tmp_path):
    """Nulls, empty texts, ties, repeated rows and clashing columns, stage by stage against plain versions."""
    schema = "doc_id long, quality int"
    good = [d for d, t, _ in rows if d is not None and t and "x" * 50 not in t]
    spark.createDataFrame([(d, int(d in good)) for d, _, _ in rows if d is not None], schema).write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    model = quality.fit(quality.training_rows(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))), list(quality.statistics("text")))
    scores = Counter((r.doc_id, r.predicted) for r in quality.scored(docs, model).collect())
    first = stages["quality"](spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    assert Counter(r.doc_id for r in first.collect()) == Counter({d: n for (d, p), n in scores.items() if p})

    largest = {}
    for d, t, _ in rows:
        largest[t or ""] = max(largest.get(t or "", -1), -1 if d is None else d)
    second = stages["exact_copies"](spark, docs, str(tmp_path))
    assert second.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in second.collect()) == Counter((d, t) for t, d in largest.items())
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert Counter(r.text or "" for r in stages["exact_copies"](spark, nameless, str(tmp_path)).collect()) == Counter(set(largest))

    component = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).collect()}
    third = stages["near_copies"](spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in third) == Counter((d, t) for d, t, _ in rows if d is None or component[d] == d)

    taken = {(r.doc_id, r["size"]): r.taken for r in mixing.mix(docs).collect()}
    fourth = stages["mixture"](spark, docs, str(tmp_path)).collect()
    n = Counter(r.doc_id for r in fourth)
    assert all(n[d] == int(t / size + 0.5) for (d, size), t in taken.items() if size and d not in (40, None))
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(d for d, _, _ in rows)
    none = docs.where("false")
    assert all(stage(spark, none, str(tmp_path)).count() == 0 for stage in stages.values())
