import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlode.llm import line_dedup as D


def brute(rows):
    """Dropped line numbers of each row, in the order of ``rows``."""
    items, places = {}, []
    for i, (_, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            key = line.lower().strip()
            if key:
                places.append((i, n, items.setdefault(key, len(items))))
    s = [frozenset(t[i : i + 8] for i in range(max(1, len(t) - 7))) for t in items]
    inverted, parent = defaultdict(list), list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(s):
        for j, n in Counter(j for g in x for j in inverted[g]).items():
            if n >= 0.8 * (len(x) + len(s[j]) - n):
                parent[find(i)] = find(j)
        for g in x:
            inverted[g].append(i)
    seen, out = set(), defaultdict(list)
    for i, n, k in places:
        if find(k) in seen:
            out[i].append(n)
        seen.add(find(k))
    return out


def compare(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    want = brute(rows)
    out = {r.doc_id: r for r in D.line_dedup(docs).collect()}
    assert len(out) == len(rows)
    for i, (d, text) in enumerate(rows):
        assert out[d].dropped == want[i]
        assert out[d].n_dropped == len(want[i])
        assert out[d].n_lines == (text or "").count("\n") + 1


def test_small(spark):
    compare(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_fuzzy(make):
    from .conftest import rows_of

    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefghij ", k=n)) for n in (30, 90, 140, 150, 190, 400, 1500) for _ in range(4)]
    texts = []
    for _ in range(60):
        lines = []
        for line in rng.sample(base, 5):
            i = rng.randrange(len(line))
            lines.append(rng.choice([line, line.upper(), "  " + line, line[:i] + "Ж" + line[i:], line + "!", line[2:]]))
        texts.append("\n".join([*lines, "", "  "]))
    compare(make(rows_of(texts)))


def test_rows_of_messy_tables(messy, empty):
    rows = sorted(((r.doc_id, r.text) for r in messy.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = brute(rows)
    for fine in (None, D.FINE):
        out = D.line_dedup(messy, fine=fine).collect()
        # rows of one id may change places among each other
        assert sorted(Counter(r.doc_id for r in out).items(), key=str) == sorted(Counter(d for d, _ in rows).items(), key=str)
        assert sum(r.n_dropped for r in out) == sum(map(len, want.values()))
        once = [d for d, n in Counter(d for d, _ in rows).items() if n == 1]
        assert {r.doc_id: r.dropped for r in out if r.doc_id in once} == {d: want[i] for i, (d, _) in enumerate(rows) if d in once}
    assert D.report(D.line_dedup(empty)).collect() == []


def test_hot_lines(make):
    from .conftest import rows_of

    compare(make(rows_of([f"the same line in all of the texts\nown line {i} of {i * 7919}" for i in range(300)])))


def test_a_hot_line_is_verified_once(make):
    """However many tasks hold a line, one row of it reaches the verification."""
    from .conftest import rows_of

    docs = make(rows_of(["the same line in all of the texts\nthe same line in all of the text"] * 300)).selectExpr("text AS _text")
    every = np.full(1 << 13, 255, dtype=np.uint8)
    for n in (1, 4, 16):
        assert D.candidate_lines(docs.repartition(n), every).count() == 2


def test_lines_met(monkeypatch):
    monkeypatch.setattr(D, "MET_SLOTS", 4)
    met = D.Met()
    assert met.fresh(np.array([0, 5, 0, 6, 5])).tolist() == [0, 1, 3]
    assert met.fresh(np.array([0, 5, 6, 9])).tolist() == [3]
    assert met.fresh(np.array([5, -1])).tolist() == [0, 1]


def test_lines_of_one_hash(spark, monkeypatch):
    """Different lines of one 64-bit hash stay; the further bits tell them apart."""
    monkeypatch.setattr(D.Lines, "hashes", lambda self: np.full(len(self.line), 7, dtype=np.uint64))
    lines = D.Lines(["one line\nanother line\none line"])
    assert len(set(lines.checks().tolist())) == 2 and lines.checks()[0] == lines.checks()[2]


def test_drop_lines(spark):
    df = spark.createDataFrame([("a\nb\nc", [0, 2]), (None, []), ("a", [0])], "text string, dropped array<long>")
    assert [r.text for r in D.drop_lines(df).collect()] == ["b", "", ""]


def test_shared_keys(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 300), rng.randint(0, 40), 1) for _ in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted((r["_key"], r["_row"]) for r in D.shared_keys(spark.createDataFrame(rows, "_key long, _row long, _n long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    items = defaultdict(set)
    for k, r, _ in rows:
        items[k].add(r)
    assert got == sorted((k, r) for k, v in items.items() if len(v) > 1 for r in v)


def test_shared_keys_of_like_sizes(spark):
    """Items of sizes that cannot reach the threshold do not count as neighbours."""
    rows = [(1, 10, 50), (1, 11, 41), (1, 12, 30), (1, 11, 41), (2, 10, 50), (2, 12, 30), (3, 12, 30)]
    got = D.shared_keys(spark.createDataFrame(rows, "_key long, _row long, _n long")).collect()
    assert sorted((r["_key"], r["_row"]) for r in got) == [(1, 10), (1, 11)]


@pytest.mark.parametrize("n", [3, 50, 300])
def test_similar_lines_share_a_key(n):
    """Recall at the threshold, over both kinds of signature."""
    rng = random.Random(n)
    hits = trials = 0
    for _ in range(60):
        a = "".join(rng.choices("abcdefghijklmnop", k=n + 20))
        b = a + "".join(rng.choices("abcdefghijklmnop", k=max(1, (n + 13) // 8)))
        lines = D.Lines([a, b])
        _, at, keys = D.signatures(lines, np.arange(2), 8, 0.8, 12, 4)
        hits += bool(set(keys[at == 0].tolist()) & set(keys[at == 1].tolist()))
        trials += 1
    assert hits >= 0.95 * trials


def test_columns_pass(spark):
    docs = spark.createDataFrame([(1, "x\nx", "own")], "doc_id long, text string, dropped string")
    assert D.line_dedup(docs).select(F.col("dropped")).first().dropped == [1]


def test_short_lines_with_an_edit(make):
    """One substituted character or digit anywhere in lines of 30 to 80 characters."""
    from .conftest import rows_of

    rng = random.Random(30)
    lines, edited = [], []
    for i in range(300):
        n = 30 + i % 51
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
        at = rng.randrange(n)
        lines.append(line)
        edited.append(line[:at] + ("#" if i % 2 else "Ж") + line[at + 1 :])
    own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=30 + i % 51)) for i in range(300)]
    docs = make(rows_of([*lines, *edited, *own]))
    out = {r.doc_id: r.n_dropped for r in D.line_dedup(docs, fine=D.FINE).collect()}
    assert sum(out[i] for i in [*range(300), *range(600, 900)]) == 0
    assert sum(out[300 + i] for i in range(300)) >= 297
    # what is linked by the longer shingles stays linked
    long = "".join(rng.choices("abcdefghij ", k=400))
    docs = make(rows_of([long, long[:200] + "Ж" + long[200:], "x" * 118 + long[:1], "x" * 118 + long[:4]]))
    kept, more = ({r.doc_id: r.dropped for r in D.line_dedup(docs, fine=f).collect()} for f in (None, D.FINE))
    assert all(set(kept[i]) <= set(more[i]) for i in kept) and kept[1] == [0]


def test_the_query_compares_short_lines(spark, tmp_path):
    from seqlode.llm import registry

    text = "Copyright (c) 2{}19 by the authors"
    spark.createDataFrame([(1, text.format(0)), (2, text.format(1))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_dropped for r in registry.op8_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def test_band_keys_are_sorted_in_parts(spark, monkeypatch):
    """No exchange holds all band keys, and the table of lines is kept without them."""
    seen, names = [], []
    shared_keys, materialize = D.shared_keys, D.materialize
    monkeypatch.setattr(D, "shared_keys", lambda keys, threshold: seen.append(keys.count()) or shared_keys(keys, threshold))
    monkeypatch.setattr(D, "materialize", lambda df, tag: names.append((tag, df.columns)) or materialize(df, tag))
    rows = [(i, "\n".join(f"line {i} {j} " + "abcdefghij"[j % 10] * 9 + str(i * j) * 40 for j in range(20))) for i in range(30)]
    D.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), fine=D.FINE).collect()
    assert len(seen) > 1 and max(seen) < 0.6 * sum(seen)
    assert not [c for c in [cols for tag, cols in names if tag == "lines"][-1] if c.startswith("_keys")]


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(5)
    for n in (1, 20, 60, 110):
        a = np.unique(rng.integers(0, 1 << 44, n, dtype=np.uint64))
        b = np.unique(np.r_[a[n // 4 :], rng.integers(0, 1 << 44, n // 4 + 1, dtype=np.uint64)])
        x, none, y = D.sketches(np.r_[a, b], np.array([len(a), 0, len(b)]))
        assert none == 0 and int(x ^ y).bit_count() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("batch", [3, 50, 10_000])
def test_shared_keys_by_sketch(spark, batch):
    """Of items that share a key those without one of a like size and sketch go, whatever the batches; all bits count."""
    rng = random.Random(6)
    rows = [(k, 1000 * k + i, rng.choice([40, 50, 60]), rng.choice([0, (1 << 8) - 1, (1 << 20) - 1, -1, -1 << 63, (-1 << 63) + 1])) for k in range(60) for i in range(rng.choice([1, 2, 3, 9]))]
    # a bucket that is not looked at in pairs
    rows += [(99, i, 50, -1 if i % 2 else 0) for i in range(D.SKETCHED + 50)]
    rows = [*rows, *rng.sample(rows, 50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = sorted((r["_key"], r["_row"]) for r in D.shared_keys(spark.createDataFrame(rows, "_key long, _row long, _n long, _sketch long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def like(x, y):
        apart = ((x[3] ^ y[3]) & (1 << 64) - 1).bit_count()
        return x[:2] != y[:2] and x[0] == y[0] and min(x[2], y[2]) >= 0.8 * max(x[2], y[2]) and (apart <= (x[2] + y[2]) / 9 or x[0] == 99)

    assert got == sorted({x[:2] for x in rows if any(like(x, y) for y in rows)})


def test_unrelated_short_lines_are_no_candidates(make, monkeypatch):
    """Lines of few words share buckets, not links: their texts are not fetched, and what is linked stays so."""
    from .conftest import rows_of

    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(14)]
    lines = list(dict.fromkeys(" ".join(rng.sample(words, 9)) for _ in range(400)))
    lines += [line[:i] + "Ж" + line[i:] for line in lines[::10] for i in [rng.randrange(len(line))]]
    sets = [frozenset(t.lower()[i : i + 3] for i in range(len(t) - 2)) for t in lines]
    links = {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    parent = list(range(len(lines)))
    for i, j in sorted(links, key=lambda x: x[1]):
        label = {parent[i], parent[j]}
        parent = [min(label) if p in label else p for p in parent]
    seen = []
    groups = D.near.candidate_groups
    monkeypatch.setattr(D.near, "candidate_groups", lambda keys: seen.append(keys.select("_row").distinct().count()) or groups(keys))
    out = {r.doc_id: r.n_dropped for r in D.line_dedup(make(rows_of(lines)), fine=D.FINE).collect()}
    assert [out[i] for i in range(len(lines))] == [int(p != i) for i, p in enumerate(parent)]
    assert len({i for x in links for i in x}) <= seen[1] < 0.6 * len(lines)


def test_lines_as_arrays():
    texts = ["", "  ", "\t one \n\n two", " " * 50 + "three" + "　" * 30 + "\n" + " " * 40, "x\n" + " y" * 40, "😀 é" * 9 + " \n ab \n" + "z" * 300, "ab"]
    lines = D.Lines(texts)
    want = [x.strip() for t in texts for x in t.split("\n")]
    assert [lines.text(i) for i in range(len(lines.start))] == want
    assert lines.blank.tolist() == [not x for x in want]
    full = np.flatnonzero(~lines.blank)
    assert lines.checks(full[1::2]).tolist() == lines.checks()[full[1::2]].tolist()
    # most lines at once and each by itself
    at, h = lines.shingles(full, 8)
    for i, line in enumerate(full):
        assert lines.shingles(np.array([line]), 8)[1].tolist() == h[at == i].tolist()
        assert len(h[at == i]) == len({want[line][j : j + 8] for j in range(max(1, len(want[line]) - 7))})


def test_keys_are_dealt_in_cells(spark):
    """Keys reach the search in blocks, not as rows, and the search finds what it finds in rows."""
    rng = random.Random(8)
    texts = ["\n".join("".join(rng.choices("abcd ", k=rng.choice([9, 30, 110, 300]))) for _ in range(20)) for _ in range(20)]
    texts += [t.replace("a ", "b ", 1) for t in texts]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_row long, _id long, _text string").repartition(3)
    found = D.occurrences(docs, 8, 0.8, 12, 4, (3, 16, 5), 7).cache()
    blocks = found.where("_line = -2")
    cells = [r for p in D._key_columns() for r in blocks.select("_n", p).where(f"{p} IS NOT NULL").collect()]
    assert len(cells) <= 3 * 7 * D.KEY_PARTS and {r[0] for r in cells} <= set(range(7))
    rows = np.concatenate([np.frombuffer(r[1], dtype=np.int64).reshape(4, -1) for r in cells], axis=1)
    # of each line all keys are there, and sketches for the shorter shingles only
    lines = D.Lines(texts)
    short, long = ((np.flatnonzero(x & ~lines.blank)) for x in (lines.end - lines.start <= D.FINE_CHARS, lines.end - lines.start > D.FINE_CHARS))
    hashes = lines.hashes().view(np.int64)
    fine = rows[:, rows[0] & 1 == 1]
    assert {(k | 1, hashes[short[i]]) for _, at, keys in [D.signatures(lines, short, 3, 0.8, 16, 5)] for i, k in zip(at, keys.view(np.int64), strict=True)} <= set(zip(fine[0], fine[1], strict=True))
    assert set(hashes[long]) <= set(rows[1, rows[0] & 1 == 0]) and not rows[3, rows[0] & 1 == 0].any() and fine[3].all()
    got = [D.shared_keys(blocks.selectExpr("_n AS _cell", f"{p} AS _keys").where("_keys IS NOT NULL")) for p in D._key_columns()]
    want = D.shared_keys(spark.createDataFrame(rows.T.tolist(), "_key long, _row long, _n long, _sketch long"))
    out = sorted(tuple(r) for df in got for r in df.collect())
    assert out == sorted(tuple(r) for r in want.collect()) and out
    found.unpersist()
