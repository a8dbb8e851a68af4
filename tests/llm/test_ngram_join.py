import random
from collections import Counter, defaultdict

import pytest

from seqlode.llm import near
from seqlode.llm import ngram_join as N


def sets(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def brute(rows):
    """Links of every row and the root of its class, by an inverted index."""
    s = [sets(t) for _, t in rows]
    inverted, links, parent = defaultdict(list), Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bare = [i for i, x in enumerate(s) if not x]
    for i, x in enumerate(s):
        common = Counter(j for g in x for j in inverted[g])
        if not x:
            common = {j: 1 for j in bare if j < i}
        for j, n in common.items():
            if not x or n >= 0.8 * (len(x) + len(s[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in x:
            inverted[g].append(i)
    return links, [find(i) for i in range(len(rows))]


def compare(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    links, root = brute(rows)
    want = sorted((repr(d), repr(rows[root[i]][0]), links[i], root.count(root[i])) for i, (d, _) in enumerate(rows))
    out = N.ngram_join(docs).collect()
    assert sorted((repr(r.doc_id), repr(r.class_id), r.n_links, r.class_size) for r in out) == want
    assert sum(r.kept for r in out) == len(set(root))


def near_copies(n, words=60, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        if rng.random() < 0.9:
            w[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_small(spark):
    compare(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


@pytest.mark.parametrize("block", [1024, 16])
def test_large_group(make, monkeypatch, block):
    """A group of near copies, in one tile and in many."""
    from .conftest import rows_of

    monkeypatch.setattr(near, "BLOCK", block)
    compare(make(rows_of(near_copies(120) + ["other text entirely here now"] * 3)))


def test_messy(messy):
    compare(messy)


def test_empty(empty):
    assert N.ngram_join(empty).collect() == []


def test_tiles_go_on_in_later_batches(spark, make):
    from .conftest import rows_of

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        compare(make(rows_of(near_copies(90) + near_copies(2, seed=1) + near_copies(3, seed=2))))
    finally:
        spark.conf.set(name, was)
