"""First-fit packing, vector codes and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import filter_audit, first_fit, packing, vector_codes
from lattica.llm.queries import byte_tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(byte_tokenizer())


def _mixed(r, n):
    return "".join(r.choice(["a", "B", "é", "ß", "7", "0", " ", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'ll", "'Re", "!", "$$", "the ", " word", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("together", [30, packing.TOGETHER])
def test_byte_tokens(tokenizer, monkeypatch, together):
    monkeypatch.setattr(packing, "TOGETHER", together)
    monkeypatch.setattr(first_fit, "TOGETHER", together)
    r = random.Random(1)
    texts = ["", " ", "\n\n", "it's 'tis ''s  's'd", "x" * 90, " " * 100 + "y", "日本 and é", "a <|endoftext|> b", "soft\xadhyphen ²"]
    texts += [_mixed(r, r.randrange(1, 120)) for _ in range(800)]
    tokens = first_fit.ByteTokens(byte_tokenizer())
    for _ in range(2):  # the second time, all strings are known
        got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_first_fit_decreasing():
    r = random.Random(2)
    for _ in range(60):
        capacity = r.choice([16, 64])
        sizes = [r.randrange(1, capacity + 1) for _ in range(r.randrange(80))]
        room, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((b for b, x in enumerate(room) if x >= sizes[i]), len(room))
            if b == len(room):
                room.append(capacity)
                want.append([])
            room[b] -= sizes[i]
            want[b].append(i)
        bins = first_fit.first_fit_decreasing(sizes, capacity)
        assert bins == want
        packed = first_fit.without_padding(bins, sizes, capacity)
        used = [sum(n for _, _, n in p) for p in packed]
        assert all(0 < u <= capacity and u & (u - 1) == 0 for u in used)
        covered = defaultdict(list)
        for i, start, n in itertools.chain(*packed):
            covered[i] += range(start, start + n)
        assert {i: sorted(x) for i, x in covered.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}
        assert sum(len(p) for p in packed) <= len(sizes) + len(packed) + len(bins)


@pytest.mark.parametrize("group", [2, first_fit.GROUP])
def test_pack_first_fit(spark, docs, rows, tokenizer, group):
    got = first_fit.pack_first_fit(docs, byte_tokenizer(), group=group, with_ids=True).collect()
    plain = first_fit.pack_first_fit(docs, byte_tokenizer(), group=group).collect()
    assert sum(x.length for x in plain) == sum(x.length for x in got)
    again = first_fit.pack_first_fit(docs, byte_tokenizer(), group=group).collect()
    assert sorted(map(str, plain)) == sorted(map(str, again))
    want = Counter()
    for d, t, _ in rows:
        want[d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    sequences, pieces = defaultdict(list), defaultdict(list)
    for x in got:
        ids = np.frombuffer(bytes(x.ids), "<u4").tolist()
        assert len(ids) == x.length and zlib.crc32(bytes(x.ids)) == x.ids_crc32
        sequences[x.sequence_id].append((x.offset, x.length))
        pieces[x.doc_id, x.doc_tokens, x.start].append(ids)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    # Every document can be put together from its pieces, each used once.
    for (d, ids), n in want.items():
        for _ in range(n):
            at = 0
            while at < len(ids):
                options = pieces[d, len(ids), at]
                i = next(i for i, p in enumerate(options) if tuple(p) == ids[at : at + len(p)])
                at += len(options.pop(i))
    assert not any(pieces.values())
    assert first_fit.pack_first_fit(docs.where("false"), byte_tokenizer()).collect() == []


def test_pack_first_fit_cuts_few_documents(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, "word " * r.randrange(1, 1500)) for i in range(600)], "doc_id long, text string")
    got = Counter(x.doc_id for x in first_fit.pack_first_fit(df, byte_tokenizer()).collect())
    assert len(got) == 600 and sum(n > 1 for n in got.values()) < 60


def _coded(rows, parts, size, rounds):
    good = []
    for vec_id, v, label in rows:
        if v and all(x is not None and np.isfinite(x) and abs(x) < 1e7 for x in v):
            good.append((vec_id, [int(np.floor(256 * x)) for x in v], label))
    good.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    if not good:
        return []
    dims = len(good[0][1])
    good = [x for x in good if len(x[1]) == dims]
    cut = [dims * i // parts for i in range(parts + 1)]
    books = [[x[1][a:b] for x in good[:size]] for a, b in zip(cut, cut[1:])]

    def nearest(x, book):
        d = [sum((p - q) ** 2 for p, q in zip(x, e)) for e in book]
        return min(range(len(d)), key=lambda i: (d[i], i)), min(d)

    for _ in range(rounds):
        new = []
        for k, book in enumerate(books):
            held = defaultdict(list)
            for _, v, _ in good:
                held[nearest(v[cut[k] : cut[k + 1]], book)[0]].append(v[cut[k] : cut[k + 1]])
            new.append([[sum(c) // len(c) for c in zip(*held[i])] if i in held else e for i, e in enumerate(book)])
        books = new
    out, by_label = [], Counter()
    for vec_id, v, label in good:
        each = [nearest(v[a:b], book) for a, b, book in zip(cut, cut[1:], books)]
        out.append((vec_id, "".join(f"{i:02x}" for i, _ in each), sum(d for _, d in each), label))
        by_label[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, c, e, by_label[label], sha) for i, c, e, label in out]


@pytest.mark.parametrize("dims,hot", [(64, 1000), (21, 1000), (5, 3)])
def test_encode_vectors(spark, monkeypatch, dims, hot):
    monkeypatch.setattr(vector_codes, "HOT", hot)
    r = random.Random(dims)
    rows = [(r.randrange(150), [r.choice([r.gauss(0, 1), 0.5, -0.25]) for _ in range(dims)], r.choice([None, 0, 0, 0, *range(40)])) for _ in range(200)]
    rows += rows[:5] + [(-1, None, 1), (-2, [], 1), (-3, [float("nan")] * dims, 1), (-4, [None] + [0.0] * (dims - 1), 1), (-5, [float("inf")] * dims, None)]
    rows += [(None, [1.0] * dims, 0), (300, [1.0] * (dims + 1), 0), (301, [1e300] * dims, 0), (302, [900.0] * dims, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("v", "d", "x", "l", "n", "error", "code", "often"):
        df = df.withColumn(c, F.lit("extra"))
    size = 20 if dims == 5 else 64
    got = vector_codes.encode_vectors(df.repartition(3), size=size).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(_coded(rows, 16, size, 2))
    assert vector_codes.encode_vectors(df.where("false")).collect() == []


def test_nearest_entries_prunes_and_breaks_ties():
    r = np.random.default_rng(5)
    entries = r.integers(-200, 200, (64, 4))
    entries[40] = entries[3]
    x = np.concatenate([r.integers(-200, 200, (500, 4)), entries])
    pivots = vector_codes.choose_pivots(entries, 4)
    of, to = vector_codes._distances(entries, pivots), vector_codes._distances(x, pivots).astype(np.float32).astype(float)
    at, best, worked = vector_codes.nearest_entries(x, to, entries, of)
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert at[500 + 40] == 3
    assert worked < 0.2 * d.size


def _audited(rows, labels, fails, names):
    marks = defaultdict(lambda: [0, 0])
    for d, q, t in labels:
        if d is not None:
            marks[d] = [marks[d][0] | (q == 1), marks[d][1] | (t == 1)]
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = [(s or "", fails(t or "") + ("E" if d is not None and least[t or ""] < d else ""), *(marks[d] if d is not None else (0, 0))) for d, t, s in rows]
    out = {}
    for part in {x[0] for x in docs}:
        mine, shapley = [x[1:] for x in docs if x[0] == part], Counter()
        for order in itertools.permutations(names):
            left = mine
            for step, f in enumerate(order, 1):
                gone, kept = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                before = [x for x in mine if f in x[0] and set(x[0]) & set(order[: step - 1])]
                out[part, "".join(order), step] = [len(kept), len(gone), len(before), sum(x[0] == f for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                shapley[f] += len(gone)
                left = kept
        for order in itertools.permutations(names):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def _text_fails(t):
    w = re.findall("[^\\x20\\x09-\\x0D]+", t)
    return "".join(
        f for f, bad in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", re.search("[#$%&*|]", t))) if bad
    )


def test_filter_audit(spark, rows):
    r = random.Random(7)
    words = ["plain", "é ñ", "Big", "a$b", "日本", "\U0001f600x"]
    rows = [*rows, (50, "\n lead and trail \t", "a"), (51, "same", ""), (40, "same", "b"), (None, None, None), (None, "same", "hot"), (52, "x" * 50_000, "hot")]
    rows += [(r.randrange(60, 400), " ".join(r.choices(words, weights=[9, 1, 1, 1, 1, 1], k=r.choice([3, 60]))) + (f" {r.random()}" if r.random() < 0.5 else ""), r.choice(["hot", "hot", "b", None])) for _ in range(400)]
    rows += [(r.randrange(400), "a copy of which there are many", "hot") for _ in range(200)]
    labels = [(r.randrange(400), r.choice([0, 1, None]), r.choice([0, 0, 1])) for _ in range(300)] + [(None, 1, 1), (40, 1, 0), (40, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("part", "mask", "n", "words", "good", "digest", "first", "k", "own", "edge"):
        docs = docs.withColumn(c, F.lit("extra"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("k", F.lit("extra"))
    got = filter_audit.filter_audit(docs.repartition(3), marks).collect()
    assert {tuple(x)[:3]: list(x)[3:] for x in got} == _audited(rows, labels, _text_fails, "ABCDE")
    assert len(got) == 600 * len({s or "" for _, _, s in rows})
    assert filter_audit.filter_audit(docs.where("false"), marks).collect() == []


def test_paths_and_lattice():
    for k in (1, 3, 6):
        names = "ABCDEF"[:k]
        forward, backward = filter_audit.paths(k)
        assert all(forward[s] * backward[s] == sum({*o[: bin(s).count("1")]} == {i for i in range(k) if s >> i & 1} for o in itertools.permutations(range(k))) for s in range(1 << k))
        edges = filter_audit.lattice(names)
        assert len(edges) == k * 2 ** (k - 1)
        assert all(sum(w for _, f, _, _, w in edges if f == name) == forward[-1] for name in names)
