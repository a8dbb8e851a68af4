"""Operators against hand-computed values and brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlode.functions import keys, ngrams, tokens
from seqlode.functions.indexing import dense_index
from seqlode.operators import align, bpe, groundtruth, metrics, pmi, quantize, rank, similarity, stats, tfidf
from seqlode.plans.systems import System, candidates, ranking, similarities


def corpus(spark, *seqs, id_col="doc_idx"):
    return spark.createDataFrame([(i, list(s)) for i, s in enumerate(seqs)], f"{id_col} long, tokens array<int>")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# columns


@pytest.mark.parametrize(("path", "stem", "suffix"), [("a/b/THE_word_01.wav", "THE_word_01", "01"), ("x.tar.gz", "x.tar", "x.tar"), (".hidden", ".hidden", ".hidden"), ("plain", "plain", "plain"), ("a/b/", "b", "b")])
def test_stems(spark, path, stem, suffix):
    assert one(spark, keys.path_stem(F.lit(path))) == stem
    assert one(spark, keys.normalized_id(F.lit(path))) == suffix


def test_tags_and_gains(spark):
    assert one(spark, keys.config_tag(F.lit("m"), F.lit(9), F.lit(100))) == "m_l9_k100"
    assert one(spark, keys.relative_gain(F.lit(0.6), F.lit(0.5))) == pytest.approx(0.2)
    assert one(spark, keys.relative_gain(F.lit(1e-9), F.lit(0.0))) == pytest.approx(1.0)


@pytest.mark.parametrize(("cell", "want"), [("1,2,3", [1, 2, 3]), (" 1  2 -3 ", [1, 2, -3]), ("1,x, 2 ", [1, 2]), ("", []), ("[1,2,3]", [2]), ("--5 7", [7]), ("5 6,7", [7])])
def test_plain_cells(spark, cell, want):
    assert one(spark, tokens.parse_tokens(F.lit(cell))) == want


@pytest.mark.parametrize(("cell", "want"), [("[1, 2, 3]", [1, 2, 3]), ("4, 5", [4, 5]), ("", []), ("[]", [])])
def test_json_cells(spark, cell, want):
    assert one(spark, tokens.parse_json_tokens(F.lit(cell))) == want


def test_ngrams(spark):
    t = F.array(*map(F.lit, [1, 2, 3]))
    assert one(spark, ngrams.ngrams(t, 1)) == [[1], [2], [3]]
    assert one(spark, ngrams.ngrams(t, 2)) == [[1, 2], [2, 3]]
    assert one(spark, ngrams.ngrams(t, 3)) == [[1, 2, 3]]
    assert one(spark, ngrams.ngrams(t, 4)) == []


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(9)
    rows = dense_index(df, ["v"], "n", 5).collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.v)] == list(range(5, 1005))
    assert dense_index(df.limit(0), ["v"], "n").collect() == []


# statistics and weights


def test_idf_signs(spark):
    docs = corpus(spark, [1, 2], [1, 2], [1, 3])
    idf = {r.gram[0]: r.idf for r in stats.idf_table(docs).collect()}
    assert idf[1] == pytest.approx(math.log(3 / 4))
    assert idf[2] == 0
    assert idf[3] == pytest.approx(math.log(3 / 2))


def brute_weights(docs, seq, tau=None, alpha=1.0):
    n, df = len(docs), Counter(t for d in docs for t in set(d))
    uni, bi = Counter(t for d in docs for t in d), Counter(p for d in docs for p in zip(d, d[1:]))
    chosen = set()
    if tau is not None:
        chosen = {p for p, c in bi.items() if c >= 2 and math.log((c / sum(bi.values())) / (uni[p[0]] / sum(uni.values()) * uni[p[1]] / sum(uni.values()))) > tau}
    pair_df = Counter(p for d in docs for p in set(zip(d, d[1:])) if p in chosen)
    w = {(t,): c / len(seq) * math.log(n / (1 + df[t])) for t, c in Counter(seq).items() if t in df}
    if alpha > 0:
        w |= {p: alpha * c / (len(seq) - 1) * math.log(n / (1 + pair_df[p])) for p, c in Counter(zip(seq, seq[1:])).items() if p in chosen}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {k: x / (norm or 1) for k, x in w.items()}


@pytest.mark.parametrize(("tau", "alpha"), [(None, 1.0), (0.0, 1.0), (0.3, 2.0), (0.0, 0.0)])
def test_weights_against_brute_force(spark, tau, alpha):
    rng = random.Random(11)
    docs = [[rng.randint(0, 8) for _ in range(rng.randint(1, 20))] for _ in range(25)]
    queries = [[rng.randint(0, 10) for _ in range(rng.randint(1, 9))] for _ in range(6)]
    df = corpus(spark, *docs)
    model = tfidf.UnigramModel.fit(df) if tau is None else tfidf.PairModel.fit(df, tau, alpha)
    got = defaultdict(dict)
    for r in model.weights(corpus(spark, *queries, id_col="query_idx"), "query_idx").collect():
        got[r.query_idx][tuple(r.gram)] = r.w
    for i, q in enumerate(queries):
        assert got[i] == pytest.approx(brute_weights(docs, q, tau, alpha))


def test_zero_vector_stays_zero(spark):
    docs = corpus(spark, [1], [1], [2])
    assert {r.w for r in tfidf.UnigramModel.fit(docs).weights(docs.where("doc_idx < 2")).collect()} == {0.0}


def test_mixed_weights(spark):
    docs = [[1, 2, 1], [1, 3], [2]]
    got = {(r.doc_idx, tuple(r.gram)): r.w for r in tfidf.MixedModel.fit(corpus(spark, *docs)).weights(corpus(spark, *docs)).collect()}
    assert got[0, (1,)] == pytest.approx(2 / 3 * math.log(3 / 2))
    assert got[0, (1, 2)] == pytest.approx(1 / 2 * math.log(3) / math.sqrt(2))
    assert got[0, (1, 2, 1)] == pytest.approx(math.log(3) / math.sqrt(3))
    assert (1, (1, 3, 1)) not in got


def test_pmi_limits(spark):
    docs = corpus(spark, [1, 2, 1, 2], [3, 4], [5])
    got = {(r.a, r.b): (r.cnt, r.pmi) for r in pmi.pmi(docs).collect()}
    assert set(got) == {(1, 2)}
    assert got[1, 2][1] == pytest.approx(math.log((2 / 4) / (2 / 7 * 2 / 7)))
    scores = pmi.pmi(docs)
    assert pmi.selected_pairs(scores, got[1, 2][1]).count() == 0
    assert pmi.selected_pairs(scores, got[1, 2][1] - 1e-9).count() == 1
    assert pmi.pmi(corpus(spark, [1], [2])).count() == 0


def test_sequence_stats(spark):
    r = stats.sequence_stats(corpus(spark, [1, 2, 3], [1])).first()
    assert (r.n, r.min_len, r.max_len, r.mean_len, r.std_len, r.vocab_size) == (2, 1, 3, 2.0, 1.0, 3)


# search and rankings


def cosine(a, b):
    return round(sum(x * b.get(k, 0) for k, x in a.items()), 9)


@pytest.mark.parametrize("c", [3, 25, 40])
def test_candidates_fill_up(spark, c):
    rng = random.Random(5)
    docs = [[rng.randint(0, 30) for _ in range(rng.randint(1, 6))] for _ in range(25)]
    queries = [[rng.randint(0, 30) for _ in range(3)] for _ in range(5)] + [[99]]
    df, q = corpus(spark, *docs), corpus(spark, *queries, id_col="query_idx")
    got = defaultdict(list)
    for r in candidates(df, q, System("x", candidates=c)).orderBy("query_idx", "cand_rank").collect():
        got[r.query_idx].append(r.doc_idx)
    for i, s in enumerate(queries):
        w = brute_weights(docs, s)
        order = sorted(range(25), key=lambda d: (-cosine(w, brute_weights(docs, docs[d])), d))
        assert got[i] == order[: min(c, 25)]


def sw(q, d, match=2.0, mismatch=-1.0, gap=-2.0):
    h, best = [[0.0] * (len(d) + 1) for _ in range(len(q) + 1)], 0.0
    for i, a in enumerate(q, 1):
        for j, b in enumerate(d, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a == b else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
            best = max(best, h[i][j])
    return best


def dtw(q, d):
    inf = float("inf")
    g = [[inf] * (len(d) + 1) for _ in range(len(q) + 1)]
    g[0][0] = 0
    for i, a in enumerate(q, 1):
        for j, b in enumerate(d, 1):
            g[i][j] = (a != b) + min(g[i - 1][j], g[i][j - 1], g[i - 1][j - 1])
    return g[-1][-1]


@pytest.mark.parametrize("cells", [40, 1 << 20])
@pytest.mark.parametrize("params", [(2.0, -1.0, -2.0), (2.0, -1.0, -1.0), (1.0, -3.0, -0.5)])
def test_kernels(monkeypatch, params, cells):
    monkeypatch.setattr(align, "CELLS", cells)
    rng = random.Random(3)
    seq = lambda: [rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
    q, d = [seq() for _ in range(150)], [seq() for _ in range(150)]
    assert align.local_scores(q, d, *params) == pytest.approx([sw(a, b, *params) for a, b in zip(q, d)])
    for a, b, x in zip(q, d, align.warp_costs(q, d)):
        assert math.isnan(x) if not a or not b else x == dtw(a, b)
    assert len(align.local_scores([], [], *params)) == 0


def test_alignment_scores(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([1, 2], [3, 4]), ([], [1]), ([1], [])], "q array<int>, d array<int>")
    score = lambda **k: [r.x for r in df.select(align.alignment_score(F.col("q"), F.col("d"), **k).alias("x")).collect()]
    assert score() == [2.0, 0.0, 0.0, 0.0]
    assert score(per="best") == [1.0, 0.0, 0.0, 0.0]
    assert score(per="raw") == [6.0, 0.0, 0.0, 0.0]
    assert [r.x for r in df.select(align.warping_distance(F.col("q"), F.col("d")).alias("x")).collect()] == [0.0, 0.5, 1.0, 1.0]


def test_full_ranking(spark):
    rng = random.Random(8)
    docs = [[rng.randint(0, 12) for _ in range(rng.randint(3, 12))] for _ in range(20)]
    queries = [docs[4][1:4], [1, 2, 3, 4], [50]]
    df, q = corpus(spark, *docs), corpus(spark, *queries, id_col="query_idx")
    rows = ranking(df, q, System("x", tau=0.0, candidates=6)).orderBy("query_idx", "rank").collect()
    for i, s in enumerate(queries):
        sims = [cosine(brute_weights(docs, s, 0.0), brute_weights(docs, d, 0.0)) for d in docs]
        order = sorted(range(20), key=lambda d: (-sims[d], d))
        front = sorted(order[:6], key=lambda d: (-sw(s, docs[d]) / len(s), -sims[d], d))
        own = [r for r in rows if r.query_idx == i]
        assert [r.doc_idx for r in own] == front + order[6:]
        assert [r["rank"] for r in own] == list(range(1, 21))
    sims = similarities(df, q, System("x"))
    front = similarity.top_candidates(sims, q, df, 6)
    assert rank.tail(front, sims, q, df).count() == 3 * 14


def test_sampled_warping(spark):
    df, q = corpus(spark, *[[i, i + 1] for i in range(12)]), corpus(spark, [3, 4], id_col="query_idx")
    rows = rank.by_warping(q, df, max_docs=5).orderBy("rank").collect()
    assert len(rows) == 12 and [r.distance is None for r in rows] == [False] * 5 + [True] * 7
    assert [r.doc_idx for r in rows[5:]] == sorted(r.doc_idx for r in rows[5:])
    assert rank.by_warping(q, df).orderBy("rank").first().doc_idx == 3


def test_dense_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, similarity.cosine_distance(a, a)) == pytest.approx(0)
    assert one(spark, similarity.cosine_distance(a, z)) == 1


# metrics


def ranks(spark, *lists):
    return spark.createDataFrame([(q, d, i) for q, own in enumerate(lists) for i, d in enumerate(own, 1)], "query_idx long, doc_idx long, rank long")


def pairs(spark, *p):
    return spark.createDataFrame(list(p), "query_idx long, doc_idx long")


def test_evaluators_differ(spark):
    order, truth = ranks(spark, [5, 1, 2], [1, 2, 5], [2, 1, 5]), pairs(spark, (0, 1), (0, 2), (1, 5))
    queries = spark.range(3).withColumnRenamed("id", "query_idx")
    named = spark.createDataFrame([(0, 4), (1, 0)], "query_idx long, n_rel long")
    core = metrics.evaluate(order, truth, queries).first()
    ap0 = (1 / 2 + 2 / 3) / 2
    assert core.map == pytest.approx((ap0 + 1 / 3) / 3)
    assert core.mrr == pytest.approx((1 / 2 + 1 / 3) / 3)
    assert (core.p_at_1, core.p_at_5) == (0, pytest.approx((2 + 1) / 5 / 3))
    truth0 = truth.where("query_idx = 0")
    multi = metrics.evaluate(order, truth0, queries, "multi", named).first()
    assert multi.map == pytest.approx((1 / 2 + 2 / 3) / 4 / 2)
    strict = metrics.evaluate(order, truth0, queries, "strict", named).first()
    assert strict.map == pytest.approx((1 / 2 + 2 / 3) / 4)
    none = metrics.evaluate(order, truth0, queries.limit(0), "strict", named).first()
    assert none.map == 0
    with pytest.raises(ValueError):
        metrics.evaluate(order, truth, queries, "other")


def naive_mtwv(rows, n=300):
    s, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    t, f = y.sum(), (1 - y).sum()
    best = (-np.inf,)
    for th in np.linspace(s.min(), s.max(), n):
        pm, pf = ((y == 1) & (s < th)).sum() / t, ((y == 0) & (s >= th)).sum() / max(f, 1)
        v = round(1 - (pm + f / t * pf), 12)
        if v > best[0]:
            best = (v, pm, pf)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_mtwv(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([round(rng.random(), 2), 0.5]), int(rng.random() < 0.4)) for _ in range(80)] + [(0.3, 1)]
    r = metrics.mtwv(spark.createDataFrame(rows, "score double, label int")).first()
    assert (r.mtwv, r.p_miss, r.p_fa) == pytest.approx(naive_mtwv(rows))
    assert r.beta == pytest.approx(r.n_false / r.n_true)


def test_mtwv_limits(spark):
    r = metrics.mtwv(spark.createDataFrame([(0.1, 0), (0.9, 0)], "score double, label int")).first()
    assert (r.mtwv, r.p_miss, r.p_fa, r.n_true, r.n_false, r.beta) == (0.0, 1.0, 0.0, 0, 2, None)
    r = metrics.mtwv(spark.createDataFrame([(0.5, 1), (0.5, 1)], "score double, label int")).first()
    assert (r.mtwv, r.n_false) == (1.0, 0)


# merging


def naive_fit(seqs, merges, least=2):
    seqs, out, new = [list(s) for s in seqs], [], max(t for s in seqs for t in s) + 1
    for _ in range(merges):
        counts = Counter()
        for s in seqs:
            counts.update(zip(s, s[1:]))
        if not counts:
            break
        top = max(counts.values())
        if top < least:
            break
        pair = next(p for p in counts if counts[p] == top)
        seqs = [list(_closed(s, pair, new)) for s in seqs]
        out.append((*pair, new))
        new += 1
    return out, seqs


def _closed(s, pair, new):
    i = 0
    while i < len(s):
        if tuple(s[i : i + 2]) == pair:
            yield new
            i += 2
        else:
            yield s[i]
            i += 1


@pytest.mark.parametrize("seed", range(3))
def test_merges(spark, seed):
    rng = random.Random(seed)
    seqs = [[rng.randint(0, 3) for _ in range(rng.randint(0, 15))] for _ in range(8)] + [[0, 1]]
    docs = corpus(spark, *seqs)
    want, encoded = naive_fit(seqs, 5)
    got = bpe.fit(docs, 5)
    assert got.steps == want
    assert [r.tokens for r in got.encode(docs).orderBy("doc_idx").collect()] == encoded
    ratio = bpe.compression_ratio(docs, got.encode(docs)).first().ratio
    lengths = [(len(a), len(b)) for a, b in zip(seqs, encoded) if a]
    assert ratio == pytest.approx(sum(b / a for a, b in lengths) / len(lengths))


def test_merge_details(spark):
    docs = corpus(spark, [7, 7, 7])
    assert bpe.encode(docs, [(7, 7, 8)]).first().tokens == [8, 7]
    assert bpe.merge_frequencies(docs, [(7, 7, 8), (8, 7, 9)]).orderBy("step").collect()[0].cnt == 2
    assert bpe.fit(corpus(spark, [1, 2], [3, 4]), 5).steps == []
    assert bpe.fit(docs.limit(0), 5).steps == []
    assert bpe.fit_to_vocabulary(docs, 8).steps == []
    assert bpe.fit_to_vocabulary(docs, 9).steps == [(7, 7, 8)]
    assert bpe.compression_ratio(corpus(spark, []), corpus(spark, [])).first().ratio == 1.0
    tied = corpus(spark, [1, 2, 9, 3, 4], [3, 4, 9, 9, 1, 2])
    assert bpe.most_frequent_pair(tied).first()[:2] == (1, 2)


# ground truth and quantisation


def test_ground_truth(spark):
    q = spark.createDataFrame([(0, "THE_a_00"), (1, "X_01"), (2, "none")], "query_idx long, stem string")
    d = spark.createDataFrame([(0, "d0"), (1, "d1"), (2, "e.x")], "doc_idx long, stem string")
    rel = spark.createDataFrame([("THE_a_00", "d0", 0), ("THE_a_00", "d9", 0), ("p_01", "d0", 1), ("q_01", "d1", 2), ("THE_a_00", "e.x", 0)], "query_stem string, doc_stem string, key_order int")
    truth = groundtruth.ground_truth(q, d, rel)
    assert sorted(map(tuple, truth.collect())) == [(0, 0), (1, 1)]
    assert tuple(groundtruth.coverage(q, truth).first()) == (3, 2, 2)


def test_nearest_centroid(spark):
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0])], "token int, centroid array<double>")
    f = spark.createDataFrame([(0, [0.4, 0.1]), (1, [1.9, 0.0]), (2, [1.0, 0.0])], "i int, vec array<float>")
    assert [r.token for r in quantize.assign(f, c).orderBy("i").collect()] == [0, 1, 0]
    fitted = quantize.fit_centroids(spark.createDataFrame([([0.0],), ([0.1],), ([9.0],), ([9.1],)], "vec array<double>"), 2)
    assert sorted(r.centroid[0] for r in fitted.collect()) == pytest.approx([0.05, 9.05])


def test_ranks_of_pairs_are_those_of_the_full_ranking(spark):
    """Ties, similarities of zero (given or left out) and negative ones; document numbers with gaps."""
    import random

    from pyspark.sql import functions as F

    from seqlode.operators import rank

    rng = random.Random(8)
    ids = [3 * i + i % 2 for i in range(40)]
    docs = spark.createDataFrame([(i, [1]) for i in ids], "doc_idx long, tokens array<int>")
    queries = spark.createDataFrame([(q,) for q in range(4)], "query_idx long")
    sims = [(q, i, rng.choice([0.5, 0.25, 0.0, -0.5, 0.125])) for q in range(3) for i in rng.sample(ids, 25)]
    sims = spark.createDataFrame(sims, "query_idx long, doc_idx long, sim double")
    pairs = docs.select("doc_idx").crossJoin(queries).where(F.col("doc_idx") % 4 != 1)
    want = rank.by_similarity(sims, queries, docs).join(pairs, ["query_idx", "doc_idx"]).select("query_idx", "doc_idx", "rank")
    assert sorted(map(tuple, rank.ranks_of(pairs, sims, docs).collect())) == sorted(map(tuple, want.collect()))


def _vectors(spark, n, width=8):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(20, width))
    x = middle[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, width))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_idx long, vec array<double>")


def test_inverted_file_reaches_its_recall_with_part_of_the_pairs(spark):
    docs = _vectors(spark, 3000).persist()
    queries = docs.where("doc_idx % 100 = 0").withColumnRenamed("doc_idx", "query_idx")
    exact = {(r.query_idx, r.doc_idx) for r in similarity.dense_knn(queries, docs, 10).collect()}
    found = similarity.ivf_knn(queries, docs, 10, lists=40).collect()
    assert len(found) == len(exact) == 300
    assert len({(r.query_idx, r.doc_idx) for r in found}) == 300
    assert len(exact & {(r.query_idx, r.doc_idx) for r in found}) >= 0.9 * len(exact)


def test_inverted_file_fills_up(spark):
    docs = _vectors(spark, 60)
    queries = docs.where("doc_idx < 3").withColumnRenamed("doc_idx", "query_idx")
    # one list of many, with fewer documents than are asked for
    rows = similarity.ivf_knn(queries, docs, 20, lists=30, probes=1).groupBy("query_idx").count().collect()
    assert sorted((r.query_idx, r["count"]) for r in rows) == [(0, 20), (1, 20), (2, 20)]
    assert similarity.ivf_knn(queries, docs, 100).count() == 180
    assert similarity.ivf_knn(queries, docs.limit(0), 5).count() == 0


def test_zero_vectors_resemble_nothing(spark):
    docs = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0])], "doc_idx long, vec array<double>")
    queries = docs.withColumnRenamed("doc_idx", "query_idx")
    found = {(r.query_idx, r.doc_idx): r.sim for r in similarity.dense_knn(queries, docs, 3).collect()}
    assert found == {(a, b): float(a == b and a > 0) for a in range(3) for b in range(3)}


def test_learning_merges_past_a_written_state(spark):
    docs = spark.createDataFrame([(i, [(i * 7 + j * j) % 5 for j in range(40)]) for i in range(12)] + [(99, [])], "doc_idx long, tokens array<int>")
    found = bpe.fit(docs, bpe.WRITE_EVERY + 3)
    assert len(found.steps) == bpe.WRITE_EVERY + 3
    # each merge is the best pair of what the earlier ones leave
    for i, (a, b, new) in enumerate(found.steps):
        best = bpe.most_frequent_pair(bpe.encode(docs, found.steps[:i])).first()
        assert (a, b, new, found.counts[i]) == (best["a"], best["b"], 5 + i, best["cnt"])
    assert bpe.fit(docs.where("doc_idx = 99"), 5).steps == []
