import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlode.llm import mixing as M


def naive_targets(sizes, weights, total):
    """Share by weight, cap, share the excess again."""
    t, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 3 * sizes[i]]
        if not over:
            for i in open_:
                t[i] = left * weights[i] / w
            break
        for i in over:
            t[i] = 3.0 * sizes[i]
            open_.discard(i)
        left = total - sum(t)
    return t


@pytest.mark.parametrize("seed", range(20))
def test_targets(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 1000, rng.randint(1, 10**6)]) for _ in range(rng.randint(1, 12))]
    weights = [1 + i % 3 for i in range(len(sizes))]
    got = M.fair_targets(sizes, weights, sum(sizes))
    assert got == pytest.approx(naive_targets(sizes, weights, sum(sizes)), rel=1e-9, abs=1e-6)


def test_flow_meets_overlapping_quotas_with_few_repeats():
    patterns = [((0,), 100), ((1,), 10), ((0, 1), 50)]
    given = M.route(patterns, [100, 60])
    assert sum(n for g in given for s, n in g if s == 1) == 60
    assert sum(n for g in given for s, n in g if s == 0) == 100
    assert all(sum(n for _, n in g) <= p[1] for g, p in zip(given, patterns))
    again = M.route([((0,), 10)], [25])
    assert again == [[(0, 25)]]
    assert M.route([((0,), 10)], [100]) == [[(0, 30)]]


def test_weights_follow_code_points():
    assert M.cycle_weights(["b", None, "a", "é", "B"]) == [3, 2, 2, 1, 1]


def check(docs, rows):
    size = {}
    for r in docs.collect():
        size.setdefault((r.source, r.doc_id), []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    sources = sorted({s for s, _ in size}, key=lambda s: (s is None, s or ""))
    sums = [sum(sum(v) for (s, _), v in size.items() if s == x) for x in sources]
    want = dict(zip(sources, M.fair_targets(sums, [1 + i % 3 for i in range(len(sums))], sum(sums))))
    taken = defaultdict(int)
    for r in rows:
        s = r.members[0]
        assert r.size in size[(s, r.doc_id)]
        assert r.source_size == sums[sources.index(s)]
        assert r.target == pytest.approx(want[s])
        assert r.taken == r.repeats * r.size and 0 <= r.repeats <= 3
        taken[s] += r.taken
    return want, taken


def test_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = M.mix(M.by_source(docs)).collect()
    want, taken = check(docs, mixed)
    assert all(abs(taken[s] - want[s]) <= max(10, 0.01 * want[s]) for s in want)
    again = M.mix(M.by_source(docs.repartition(7))).collect()
    assert sorted(map(repr, mixed)) == sorted(map(repr, again))


def test_messy(messy):
    rows = M.mix(M.by_source(messy)).collect()
    assert len(rows) == messy.count()
    check(messy, rows)


def test_memberships_overlap(spark):
    docs = spark.range(200).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 10).alias("text"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"), F.lit("a"))).alias("sources")
    )
    rows = M.mix(docs).collect()
    # a and b share the second pattern; a's quota is a third, b's two thirds of all words
    assert sum(r.taken for r in rows) == 2000
    assert sum(r.taken for r in rows if r.members == ["a", "b"]) == pytest.approx(2000 * 2 / 3, abs=10)


def test_empty(empty):
    assert M.mix(M.by_source(empty)).collect() == []


def test_too_many_patterns(messy):
    with pytest.raises(ValueError):
        M.mix(M.by_source(messy), max_patterns=1)


def test_flow_of_many_patterns():
    """As cheap as linear programming over the same network, and quick for thousands of patterns."""
    rng = np.random.default_rng(3)
    small = sorted({tuple(sorted(rng.choice(6, rng.integers(1, 4), replace=False).tolist())) for _ in range(25)})
    patterns = [(m, int(w)) for m, w in zip(small, rng.integers(1, 40, len(small)), strict=True)]
    quotas = [int(x) for x in rng.integers(20, 120, 6)]
    given = M.route(patterns, quotas, 3)
    assert [sum(w for _, w in g) <= 3 * n for g, (_, n) in zip(given, patterns, strict=True)] == [True] * len(patterns)
    taken = [sum(w for g in given for m, w in g if m == q) for q in range(6)]
    assert all(a <= b for a, b in zip(taken, quotas, strict=True))
    cost = sum(max(0, sum(w for _, w in g) - k * n) for g, (_, n) in zip(given, patterns, strict=True) for k in (1, 2))
    flow, least = _brute_flow(patterns, quotas, 3)
    assert (sum(taken), cost) == (flow, least)
    many = [((int(a), int(b)), int(w)) for a, b, w in zip(rng.integers(0, 40, 5000), rng.integers(40, 80, 5000), rng.integers(1, 1000, 5000), strict=True)]
    began = time.time()
    M.route(many, [60_000] * 80, 3)
    assert time.time() - began < 30


def _brute_flow(patterns, quotas, most):
    """Flow and cost one path at a time, by the cheapest path that Bellman and Ford find."""
    p, q = len(patterns), len(quotas)
    s, t = p + q, p + q + 1
    arcs = []  # from, to, room, cost; the arc back follows

    def add(a, b, cap, cost):
        arcs.extend([[a, b, cap, cost], [b, a, 0, -cost]])

    for i, (members, words) in enumerate(patterns):
        for k in range(most):
            add(s, i, words, k)
        for m in members:
            add(i, p + m, most * words, 0)
    for m, quota in enumerate(quotas):
        add(p + m, t, quota, 0)
    flow = cost = 0
    while True:
        dist, via = {s: 0}, {}
        while True:
            moved = False
            for n, (a, b, cap, c) in enumerate(arcs):
                if cap > 0 and a in dist and dist[a] + c < dist.get(b, math.inf):
                    dist[b], via[b], moved = dist[a] + c, n, True
            if not moved:
                break
        if t not in dist:
            return flow, cost
        path, v = [], t
        while v != s:
            path.append(via[v])
            v = arcs[via[v]][0]
        push = min(arcs[n][2] for n in path)
        for n in path:
            arcs[n][2] -= push
            arcs[n ^ 1][2] += push
        flow, cost = flow + push, cost + push * dist[t]
