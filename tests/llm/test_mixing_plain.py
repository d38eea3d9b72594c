"""The mix of sources, document by document and slot by slot, against a plain version."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lattica.llm import mixing


def _targets(sizes):
    """Water level by trying which sources are full, the lowest limits for their weight first."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in open_))
        more = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not more:
            return order, {s: 2 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


@pytest.mark.parametrize("together", [5, mixing.ORDERED_TOGETHER])
def test_taken_words_of_each_document(spark, monkeypatch, together):
    monkeypatch.setattr(mixing, "ORDERED_TOGETHER", together)
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 3, 40, 200]))) + f" {i}" * r.randrange(2), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(150)]
    rows += [(500, "x y z", "a"), (None, "one two", "b"), (None, "three", "b"), (501, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    size = {(d, t): len((t or "").split()) for d, t, _ in rows}
    sizes, counts = Counter(), Counter()
    for d, t, s in rows:
        sizes[s] += size[d, t]
        counts[s] += 1
    order, target = _targets(dict(sizes))
    hashes = df.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64(F.xxhash64("doc_id", "text")).alias("hh")).collect()
    streams = defaultdict(list)
    for x in hashes:
        streams[x.source].append((x.hh % (1 + counts[x.source] // together), x.h, x.doc_id, size[x.doc_id, x.text]))
    want = Counter()
    for s, docs in streams.items():
        start, end = 0, math.floor(target[s] + 0.5)
        for _, _, d, n in sorted(docs, key=lambda x: (x[0], x[1])):
            taken = sum(max(0, min(lap * sizes[s] + start + n, end) - (lap * sizes[s] + start)) for lap in range(2))
            want[d, n, sizes[s], round(target[s], 6), taken] += 1
            start += n
    got = Counter((x.doc_id, x["size"], x.source_size, round(x.target, 6), x.taken) for x in mixing.mix(df).collect())
    assert got == want


def test_slots_of_the_schedule(spark):
    """Each point of the golden ratio belongs to the source whose part of the targets it falls into."""
    target = [700.0, 0.0, 1200.4, 90.0, 3.0]
    block, n = 7, 300
    df = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "number int, target double")
    got = [(x.number, x["rank"]) for x in mixing.schedule(df, block, n).collect()]
    bounds, total, want, rank = [], 0.0, set(), Counter()
    for i, t in enumerate(target):
        if t:
            bounds.append((total / sum(target), i))
            total += t
    slots = {i: math.ceil(math.floor(t + 0.5) / block) for i, t in enumerate(target) if t}
    for k in range(n):
        x = k * mixing.GOLDEN % 1.0
        i = max(b for b in bounds if b[0] <= x)[1]
        if rank[i] < slots[i]:
            want.add((i, rank[i]))
        rank[i] += 1
    want |= {(i, j) for i, m in slots.items() for j in range(rank[i], m)}
    assert len(got) == len(set(got)) and set(got) == want == {(i, j) for i, m in slots.items() for j in range(m)}
