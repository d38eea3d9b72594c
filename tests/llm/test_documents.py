"""Operators on documents against plain versions."""

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import exact_dedup, mixing, ngram_join, packing, quality, suffix_dedup
from lattica.llm.components import components
from lattica.llm.queries import word_tokenizer


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[t or ""].append(d)
    got = exact_dedup.duplicate_groups(docs, salts=3).collect()
    want = []
    for t, ids in groups.items():
        keep = max(i for i in ids if i is not None)
        want += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    assert Counter(map(tuple, got)) == Counter(want)


def test_exact_dedup_compares_texts_of_one_digest(spark):
    """Different texts under one digest, which real digests never give, stay apart."""
    rows = [(1, "a", 0), (2, "a", 1), (3, "b", 0), (4, "b", 2), (5, "b", 2), (None, "c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, salt int").withColumn("digest", F.lit(b"one"))
    df = df.unionByName(spark.createDataFrame([(9, "d", 3), (8, "d", 3)], "doc_id long, text string, salt int").withColumn("digest", F.lit(b"two")))
    got = exact_dedup._labelled(df, exact_dedup._labels(df)).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.kept) for x in got) == Counter(
        [(1, 2, 2, False), (2, 2, 2, True), (3, 5, 3, False), (4, 5, 3, False), (5, 5, 3, True), (None, None, 1, True), (9, 9, 2, True), (8, 9, 2, False)]
    )


def test_ngram_components(docs, rows):
    sets = {d: _shingles(t) for d, t, _ in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = ngram_join.ngram_components(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((d, len(_shingles(t)), None if d is None else root(d)) for d, t, _ in rows)


@pytest.mark.parametrize("chunk", [3, 10, ngram_join.CHUNK])
def test_ngram_components_of_one_shingle_in_most_documents(spark, chunk):
    """Texts of few shingles, one of them common, so that its list holds unconnected documents."""
    r = random.Random(12)
    common = "a very common line here"
    rows = [(i, " ".join([*r.choices("pqrs", k=r.randrange(3)), common, *r.choices("uvwx", k=r.randrange(3))])) for i in range(150)]
    rows += [(200 + i, f"{common} and then {' '.join(r.choices('klmn', k=9))}") for i in range(40)]
    sets = {d: _shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()
    assert {x.doc_id: x.component_id for x in got} == {d: root(d) for d in sets}


def test_lists_in_chunks():
    """Hubs and chunk numbers do not depend on the batches."""
    r = np.random.default_rng(2)
    rows = np.unique(np.stack([r.integers(0, 12, 200), (r.integers(0, 3, 200) << 56) + r.integers(0, 9, 200), r.integers(0, 500, 200)], axis=1), axis=0)
    want = []
    for t in range(12):
        own = rows[rows[:, 0] == t]
        for i, (_, v, rep) in enumerate(own.tolist()):
            hub = next(x for x in own.tolist() if x[1] >> 56 == v >> 56)
            want += [(t, v, rep, hub[2], hub[1], i // 4)] if len(own) > 1 else []
    for size in (1, 3, 50, 1000):
        batches = [pa.record_batch([pa.array(c) for c in rows[i : i + size].T], names=["t", "v", "rep"]) for i in range(0, len(rows), size)]
        assert [tuple(x.values()) for b in ngram_join._postings(4)(iter(batches)) for x in b.to_pylist()] == want


def test_prefix_bound_is_never_too_strict():
    for n1 in range(1, 60):
        for n2 in range(n1, min(60, n1 * 5 // 4) + 1):
            need = -(-80 * (n1 + n2) // 180)
            p1, p2 = (ngram_join.prefix_length(n, 80) for n in (n1, n2))
            # Sets that share exactly `need` elements always have one in both prefixes.
            assert p1 + p2 > 0 and need <= n1 and n1 - p1 < need and n2 - p2 < need


def test_trie_finds_exactly_the_links():
    r = np.random.default_rng(3)
    probe = np.sort(r.choice(2000, 300, replace=False)).astype(np.uint64)
    sets = [probe.copy()]
    for k in (5, 20, 32, 34, 60, 200):
        s = probe.copy()
        s[r.choice(300, k, replace=False)] += np.uint64(5000)
        sets.append(np.sort(s))
    sets.append(np.arange(9000, 9300).astype(np.uint64))
    want = [100 * len(np.intersect1d(probe, s)) >= 80 * len(np.union1d(probe, s)) for s in sets]
    assert ngram_join._trie_overlaps(probe, sets, 80) == want


def test_repeated_spans(docs, rows):
    want = _plain_spans([(d, t) for d, t, _ in rows])
    got = suffix_dedup.repeated_spans(docs, with_bytes=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeated_spans_twice_in_a_document(spark):
    """A shared passage that a later document holds twice, between equal bytes of its own."""
    r = random.Random(5)

    def text(n, of=string.ascii_letters):
        return "".join(r.choices(of, k=n))

    rows = []
    for i, n in enumerate([50, 51, 55, 60, 70, 75, 90, 200] * 3):
        p, v, w = text(n), text(60), text(60)
        rows += [(2 * i + 1, text(60, string.digits) + p + text(60, string.digits)), (2 * i + 2, v + p + w + "\n" + v + p + w)]
    got = {x.doc_id: x for x in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=True).collect()}
    for d, t in rows:
        own = t[:60].encode() + t[-60:].encode()
        want = t.encode() if d % 2 else own[:60] + own[-60:] + b"\n" + own[:60] + own[-60:]
        assert (d, bytes(got[d].kept)) == (d, want)
        assert got[d].n_spans == (0 if d % 2 else 2)


def test_induction_in_any_batches():
    """First holders of runs of open keys, whatever the cuts between batches."""
    r = np.random.default_rng(1)
    rows = np.unique(r.integers(0, [6, 3, 3, 40], (300, 4)), axis=0)
    rows = rows[~((rows[:, 0] == 5) & (rows[:, 1] > 0))]
    rows[:, 0] <<= 8
    least, runs = {}, defaultdict(set)
    for k, run, d, _ in rows.tolist():
        least[k, run] = min(d, least.get((k, run), d))
        runs[k].add(run)
    want = Counter((d, p, 1 if d > least[k, run] else 2) for k, run, d, p in rows.tolist() if d > least[k, run] or len(runs[k]) > 1)
    for size in (1, 2, 7, 50, 1000):
        batches = [pa.record_batch([pa.array(c) for c in np.insert(rows[i : i + size], 3, 0, axis=1).T], names=["k", "r", "doc", "variant", "place"]) for i in range(0, len(rows), size)]
        got = Counter((x["doc"], x["place"], x["kind"]) for b in suffix_dedup._induce(iter(batches)) for x in b.to_pylist())
        assert got == want


def _plain_spans(rows):
    """doc_id, bytes, removed bytes, runs and digest of the rest, straight from the definition."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if d is not None else 0):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], d), d)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if d is not None else 0):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return want


@pytest.mark.parametrize("together", [60, 3000, suffix_dedup.TOGETHER])
def test_repeated_spans_of_frequent_strings(spark, together):
    """A line of 40, one of 60 and a phrase of 100 bytes in most documents, in ever other contexts."""
    r = random.Random(8)

    def text(n):
        return "".join(r.choices(string.ascii_letters + " ", k=n))

    line, longer, phrase = text(40), text(60), text(100)
    rows = []
    for d in range(120):
        parts = [text(r.randrange(90)), r.choice([line, line + "\n"]), text(r.randrange(3)), longer, text(r.randrange(60)), r.choice(["", phrase]), text(30), "ab" * r.randrange(60)]
        r.shuffle(parts)
        rows.append((r.randrange(100), "".join(parts)))
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), together=together).collect()
    assert Counter(map(tuple, got)) == Counter(_plain_spans(rows))


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_runs_and_windows_across_batches(size):
    """Sorted rows in batches of any size: what a smaller document holds, and holders of open keys."""
    r = random.Random(size)

    def batches(rows, names):
        rows.sort(key=lambda x: x[0])
        for i in range(0, len(rows), size):
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows[i : i + size])], names=names)

    rows = [((key << 8) + r.randrange(2), r.choice([5, -5, 9]) if key % 3 else 4, r.randrange(6), 0, 1000 + i) for i, key in enumerate(r.choices(range(-12, 12), k=600))]
    rows = [(k if (k >> 8) % 3 else k >> 8 << 8, *rest) for k, *rest in rows]
    mark = np.iinfo(np.int64).min
    marks = [((key << 8), mark, mark, 0, suffix_dedup._MARK) for key in (-3, 3, 3, 11)]
    first, runs = {}, {}
    for k, run, d, _, _ in rows + marks:
        first[k, run] = min(first.get((k, run), d), d)
        runs.setdefault(k >> 8, set()).add((k, run))
    got = {}
    for b in suffix_dedup._induce(batches(rows + marks, ["k", "r", "doc", "variant", "place"])):
        for d, _, place, kind, part in zip(*(b.column(i).to_pylist() for i in range(5))):
            assert place not in got
            got[place] = (d, kind, part)
    for k, run, d, _, place in rows:
        is_open, held = len(runs[k >> 8]) > 1, d == first[k, run]
        by_window = (d, 2, k >> 8 & 1)
        if held:
            assert got.get(place) == (by_window if is_open else None)
        else:
            assert got[place] == (d, 1, 0) or is_open and got[place] == by_window
    assert len(got) <= len(rows)

    rows = [(w, r.choice([1, 1, 1, 2]) if w % 2 else 0, r.randrange(9), 0, i) for i, w in enumerate(r.choices(range(20), k=500))]
    first = {}
    for w, v, d, _, _ in rows:
        first[w, v] = min(first.get((w, v), d), d)
    want = sorted((d, 0, (at << 8) + 1) for w, v, d, _, at in rows if d > first[w, v])
    got = [x for b in suffix_dedup._later(batches(rows, ["w", "v", "doc", "variant", "at"])) for x in zip(*(b.column(i).to_pylist() for i in range(3)))]
    assert sorted(got) == want


def test_repeated_spans_of_many_texts_with_one_id(spark):
    r = random.Random(9)
    shared = "".join(r.choices(string.ascii_letters, k=80))
    rows = [(1, shared)] + [(2, f"{i:05} {shared} {i:05}") for i in range(400)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(_plain_spans(rows))


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    got = packing.pack_documents(docs, word_tokenizer()).collect()
    ids = Counter()
    for _, text, _ in rows:
        x = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(x), 2048):
            c = x[i : i + 2048]
            ids[(i // 2048, i, len(c), zlib.crc32(np.array(c, "<u4").tobytes()))] += 1
    assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in got) == ids
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    for content in bins.values():
        at = 0
        for r in sorted(content, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in got) // 2048)


@pytest.mark.parametrize("text", ["Don't STOP we'll", "été ÀÉÎ straße", "日本語 text 123", "á b", "<|endoftext|> x", "²½ª", "", "   ", "x" * 500, "a b\x1cc"])
def test_word_tokens_agree_with_the_tokenizer(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(word_tokenizer()).encode(text, add_special_tokens=False).ids
    got = next(packing.WordTokens(word_tokenizer()).encode([text]))
    assert np.frombuffer(got, "<u4").tolist() == want


def test_word_tokens_of_many_texts(monkeypatch):
    """Texts that are cut and words that are forgotten and learnt again give the tokenizer's ids."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "TOGETHER", 300)
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    r = random.Random(3)
    signs = string.ascii_letters + "éÀß" + "0123456789" + " \n\t  ''.,-!#"
    texts = ["".join(r.choices(signs, k=r.choice([0, 1, 30, 200, 2000]))) for _ in range(60)] + ["don't 日本", "y" * 900]
    tokenizer, w = Tokenizer.from_file(word_tokenizer()), packing.WordTokens(word_tokenizer())
    for _ in range(2):
        for t, ids in zip(texts, w.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_on_counts_keeps_every_item():
    r = np.random.default_rng(1)
    counts = np.bincount(r.integers(1, 101, 5000), minlength=101)
    left = counts.copy()
    bins = packing.dominance_reduction(left, 100) + packing.best_fit(left, 100)
    seen = np.zeros(101, int)
    for content, n in bins:
        assert sum(s * k for s, k in content) <= 100
        for s, k in content:
            seen[s] += k * n
    assert (seen == counts).all()
    assert sum(n for _, n in bins) <= 1.01 * (counts * np.arange(101)).sum() / 100 + 1


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    by = defaultdict(int)
    for _, t, s in rows:
        by[s] += size(t)
    order = sorted((s for s in by if s is not None), key=str.encode) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, open_, target = 1.5 * sum(by.values()), set(order), {}
    while True:
        share = (budget - sum(target.values())) / max(1, sum(weight[s] for s in open_))
        full = {s for s in open_ if share * weight[s] > 2 * by[s]}
        if not full:
            break
        target |= {s: 2.0 * by[s] for s in full}
        open_ -= full
    target |= {s: share * weight[s] for s in open_}
    taken = defaultdict(int)
    source = {d: s for d, t, s in rows if d is not None}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        if r.doc_id is not None and r.doc_id != 40:
            assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == by[source[r.doc_id]]
        taken[source.get(r.doc_id, "a")] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs).collect()))


def test_mixed_documents_keep_their_columns(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    takes = {r.doc_id: round(r.taken / r["size"]) for r in mixing.mix(docs).collect() if r["size"] > 1}
    n = Counter(r.doc_id for r in out.collect())
    assert all(n[d] == k for d, k in takes.items() if d is not None)


def test_quality_learns_the_label(spark):
    good = [(i, " ".join(f"word{(i * j) % 31}" for j in range(40)) + ".", 1) for i in range(150)]
    bad = [(1000 + i, "!!! ### " * (5 + i % 7) + "SHOUT", 0) for i in range(150)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in good + bad] + [(5000, None), (5001, ""), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(d, q) for d, _, q in good + bad] + [(7777, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[5000].score == got[5001].score
    held = [(got[d].predicted, q) for d, _, q in good + bad if got[d].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _, _ in good + bad)


def test_scores_are_the_rules(spark, docs, rows):
    """The compiled column against statistics and rules worked out in Python."""
    bounds = {"log_chars": 4.0, "word_length": 5.5, "upper": 0.1, "symbols": 0.0, "digits": 0.2, "stops": 0.01, "own_lines": 0.6, "line_length": 100.0}
    one = tuple(((name, at_most, b),) for name, b in bounds.items() for at_most in (True, False))
    model = quality.Rules((*one, (("log_chars", False, 3.0), ("digits", True, 0.3))), tuple(0.1 * i - 0.7 for i in range(17)), 0.25)
    texts = [(d, t) for d, t, _ in rows if d not in (None, 40)] + [(900, "A!b <c>\nA!b <c>\n\n12, é"), (901, "word " * 200_000), (902, "\n\n"), (903, "\x1f\xa0x")]

    def plain(t):
        t = t or ""
        n, lines = max(len(t), 1), t.split("\n")
        share = lambda chars: sum(c in chars for c in t) / n
        s = {"log_chars": np.log1p(len(t)), "word_length": len(t) / max(1, len(t.encode().split())), "upper": share(quality.UPPER), "symbols": share(quality.SYMBOLS), "digits": share("0123456789"), "stops": share(".,;:?"), "own_lines": len(set(lines)) / len(lines), "line_length": len(t) / len(lines)}
        z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all((s[k] <= b) == at_most for k, at_most, b in rule))
        return 1 / (1 + np.exp(-z))

    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("upper", F.lit("x"))
    got = quality.scored(df, model).collect()
    assert len(got) == len(texts)
    for x in got:
        want = plain(dict(texts)[x.doc_id])
        assert x.score == pytest.approx(want, abs=1e-12) and x.predicted == (want >= 0.3)


def test_tree_paths():
    debug = "Tree 0 (weight 1.0):\n  If (feature 1 <= 0.5)\n   If (feature 0 <= 2.0)\n    Predict: 0.0\n   Else (feature 0 > 2.0)\n    Predict: 1.0\n  Else (feature 1 > 0.5)\n   Predict: 1.0\n"
    low, high = ("b", True, 0.5), ("b", False, 0.5)
    assert quality.tree_paths(debug, ["a", "b"]) == {(low,), (high,), (("a", True, 2.0), low), (("a", False, 2.0), low)}


def test_one_class_gives_one_score(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 1), (8, 1)], "doc_id long, quality int")
    assert len({r.score for r in quality.score_quality(docs, labels).collect()}) == 1


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert ngram_join.ngram_components(none).count() == 0
    assert suffix_dedup.repeated_spans(none).count() == 0
    assert packing.pack_documents(none, word_tokenizer()).count() == 0
    assert mixing.mix(none).count() == 0
    assert quality.score_quality(none, labels).count() == 0


def test_star_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)] + [(50, 60 + i) for i in range(20)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).df.collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100} | {50: 50} | {60 + i: 50 for i in range(20)}
