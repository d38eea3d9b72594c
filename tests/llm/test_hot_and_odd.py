"""Hot keys, repeated ids and doubtful markup in the corpus operators, against plain versions."""

import hashlib
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import exact_dedup, maxscore, mixing, packing, page_diff, warc


@pytest.mark.parametrize("often", [1, 3, 1000])
def test_exact_dedup_of_many_rows_without_id(spark, monkeypatch, often):
    monkeypatch.setattr(exact_dedup, "OFTEN", often)
    rows = [(None if i % 3 else 7, "hot") for i in range(300)] + [(i, f"t{i % 40}") for i in range(100)] + [(None, "none")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((d, keep, len(ids), keep is None or d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids)
    assert Counter(map(tuple, exact_dedup.duplicate_groups(df).collect())) == want


@pytest.mark.parametrize("few,often", [(0, 2), (0, 1000), (warc.FEW, 1000)])
def test_archives_of_many_pages_without_id(spark, monkeypatch, few, often):
    monkeypatch.setattr(warc, "OFTEN", often)
    rows = [(None if i % 2 else 9, f"u{i}", "hot") for i in range(200)] + [(i, "u", f"page {i % 30}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.resolve(df, few=few).select("page_id", "url", "original", "copy").collect()
    assert len(got) == len(rows) and len({(x.page_id, x["copy"]) for x in got if x.original == 9}) == 199
    assert sum(x.original is None for x in got) == 31
    assert all(x.original in (None, x.page_id, x.page_id + 30) for x in got if x.url == "u")


def test_maxscore_where_every_row_asks(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "QUERY_NUMBERS", 64)
    g = np.random.default_rng(1)
    v = g.normal(size=(120, 8))
    df = spark.createDataFrame([(50 * i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = np.floor(256 * v).astype(int)
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in maxscore.top_k(df, shard=40).collect()}
    s = q @ q.T
    for i in range(120):
        order = [j for j in sorted(range(120), key=lambda j: (-s[i, j], j)) if j != i][:5]
        assert [got[50 * i, r] for r in range(1, 6)] == [(50 * j, s[i, j]) for j in order]


def test_dominance_takes_alike_bins_in_one_step():
    for n in (7, 50_000):
        counts = np.zeros(2049, int)
        counts[[1500, 500, 200]] = n
        began = time.time()
        bins = packing.dominance_reduction(counts.copy(), 2048)
        assert time.time() - began < 1 and len(bins) < 10
        assert (([(1500, 1), (500, 1)], n)) in bins


def test_mixing_of_a_source_without_words(spark):
    rows = [(i, None if i % 3 else " ", "empty") for i in range(400)] + [(1000 + i, "one two three", "some") for i in range(40)]
    got = {x.doc_id: x for x in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == 440 and sum(x.taken for x in got.values()) == round(got[1000].target) == 180
    assert all(x.taken == x["size"] == 0 for i, x in got.items() if i < 1000)


def test_names_of_parts_within_an_article():
    page = "<article><p>One.</p><div class='social impact'>Two.</div><p class='related'>Three.</p><p class='search'>Four.</p><section class='banner-history'>Five.</section><div class='share-buttons'>no</div><div class='ad'>no</div><p class='ad'>no</p><ul id='related'><li>no</li></ul></article><p class='notice'>Six.</p><div class='notice'>no</div>"
    lines = page_diff.page_lines(page)
    assert [t for t, _ in lines] == ["One.", "Two.", "Three.", "Four.", "Five.", "Six."]
    assert [k for _, k in lines] == [page_diff.MAIN] + 5 * [page_diff.OPEN]


def _plain_main_text(rows):
    """Pages by host in path order, each against its nearer neighbour, by a table of common subsequences."""
    hosts = defaultdict(list)
    for page_id, url, page in rows:
        rest = url.split("://")[1]
        host, _, path = rest.partition("/")
        hosts[host].append(("/" + path, page_id, page_diff.page_lines(page)))

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    def shared(a, b):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
        i = j = 0
        out = set()
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.add(i)
                i, j = i + 1, j + 1
            elif n[i + 1][j] >= n[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    texts, deleted = {}, 0
    for pages in hosts.values():
        pages.sort(key=lambda x: x[:2])
        for k, (path, page_id, lines) in enumerate(pages):
            near = [pages[x] for x in (k - 1, k + 1) if 0 <= x < len(pages)]
            near = max(near, key=lambda x: common(path, x[0])) if near else None  # the first of equal ones
            out = shared([t for t, _ in lines], [t for t, _ in near[2]]) if near else set()
            kept = [t for i, (t, kind) in enumerate(lines) if kind == page_diff.MAIN or i not in out]
            deleted += len(lines) - len(kept) if kept else 0
            texts[page_id] = "\n\n".join(kept or [t for t, _ in lines])
    return texts, deleted


def test_whole_extraction_is_the_plain_one(spark):
    """Pages without marks, whose frame differs by host, so that differencing decides."""
    g = np.random.default_rng(2)
    rows = []
    for i in range(120):
        host = int(g.integers(0, 8))
        frame = [f"Frame {host} {k}" for k in range(6) if g.random() < 0.9]
        body = [f"Body {i} {k}" for k in range(int(g.integers(0, 5)))]
        marked = f"<article><p>Said {i}</p><p>Frame {host} 2</p><div class='related history'>Frame {host} 9</div></article>" if i % 4 == 0 else ""
        lines = frame[:3] + body + frame[3:]
        rows.append((i, f"http://h{host}.example/{'abc'[i % 3]}/{'xyz'[i % 2]}{i}", f"<body>{''.join(f'<p>{x}</p>' for x in lines)}{marked}</body>"))
    want, deleted = _plain_main_text(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {x.page_id: x.text for x in page_diff.main_text(df).withColumn("x", F.lit(1)).collect()}
    assert got == want
    assert deleted > 300
