"""Registered queries, each with the SQL it is held against.

Outputs are scalar: arrays are joined to strings, doubles rounded to six digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import config_tag, normalized_id, path_stem, relative_gain
from ..operators import bpe, grid, groundtruth, metrics, pmi, quantize, rank, similarity, stats, tfidf
from . import corpora as C
from . import file_catalog as _files  # noqa: F401 - registers its queries
from . import sql as S
from .register import ORACLES, QUERIES, query
from .systems import System, candidates, evaluated, ranking, shared_ranks, shared_similarities, similarities, truth_ranks

#: Candidates of the registered systems; fewer than the documents, so the choice of candidates matters.
FEW = 20
#: Candidates of the flagship, the reference's default.
CANDIDATES = 200
#: Merges of the registered encoding queries, on event codes 0 to 4.
MERGES = [(0, 1, 5), (2, 2, 6), (5, 3, 7), (1, 4, 8)]


def _name(c: str = "gram"):
    return F.array_join(F.col(c).cast("array<string>"), " ").alias("gram")


def _r(c: str):
    return F.round(c, 6).alias(c)


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *(F.round(F.col(c), 6).alias(c) for c in df.columns if c not in keep))


# statistics


@query(f"WITH {S.USERS} SELECT count(*) AS n, min(len(tokens)) AS min_len, max(len(tokens)) AS max_len, round(avg(len(tokens)), 6) AS mean_len, round(stddev_pop(len(tokens)), 6) AS std_len, (SELECT count(DISTINCT event_type) FROM events) AS vocab_size FROM docs")
def seq_length_stats(spark, d):
    return _rounded(stats.sequence_stats(C.users(spark, d)), "n", "min_len", "max_len", "vocab_size")


@query(f"WITH {S.USERS}, {S.tok()}, {S.gram(2)} SELECT gram, count(*) AS cnt FROM gram GROUP BY gram")
def ngram_counts_bi(spark, d):
    return stats.gram_counts(C.users(spark, d), 2).select(_name(), "cnt")


@query(f"WITH {S.USERS}, {S.tok()}, {S.gram(3)} SELECT gram, count(*) AS cnt FROM gram GROUP BY gram")
def ngram_counts_tri(spark, d):
    return stats.gram_counts(C.users(spark, d), 3).select(_name(), "cnt")


@query(f"WITH {S.BASKETS}, {S.tok()}, {S.gram(2)} SELECT gram, count(*) AS cnt, count(DISTINCT doc_idx) AS df FROM gram GROUP BY gram")
def basket_pairs(spark, d):
    docs = C.baskets(spark, d)
    return stats.gram_counts(docs, 2).join(stats.document_frequency(docs, 2), "gram").select(_name(), "cnt", "df")


@query(f"WITH {S.DOCS}, {S.tok()}, {S.gram(1)} SELECT doc_idx, gram, count(*) AS cnt, max(len) AS length FROM gram GROUP BY doc_idx, gram")
def term_frequency(spark, d):
    return stats.term_counts(C.documents(spark, d)).select("doc_idx", _name(), "cnt", F.col("length").cast("long").alias("length"))


@query(f"WITH {S.DOCS}, {S.tok()}, {S.gram(1)}, {S.idf()} SELECT gram, df, round(idf, 6) AS idf FROM idf")
def unigram_df_idf(spark, d):
    return stats.idf_table(C.documents(spark, d)).select(_name(), "df", _r("idf"))


@query(f"WITH {S.USERS}, {S.tok()}, {S.gram(1)}, {S.idf()} SELECT gram, df, round(idf, 6) AS idf FROM idf")
def unigram_idf_events(spark, d):
    return stats.idf_table(C.users(spark, d)).select(_name(), "df", _r("idf"))


@query(f"WITH {S.USERS}, {S.tok()}, {S.gram(2)} SELECT gram, count(DISTINCT doc_idx) AS df FROM gram GROUP BY gram")
def bigram_df(spark, d):
    return stats.document_frequency(C.users(spark, d), 2).select(_name(), "df")


@query(f"WITH {S.DOCS}, {S.tok()}, {S.gram(1)} SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS \"column\" FROM (SELECT DISTINCT gram FROM gram)")
def vocabulary_columns(spark, d):
    return stats.numbered(stats.document_frequency(C.documents(spark, d))).select(_name(), "column")


@query(f"WITH {S.DOCS}, {S.tok()}, {S.gram(1)}, {S.idf()} SELECT round(avg(idf), 6) AS mean_idf, round(stddev_pop(idf), 6) AS std_idf, round(min(idf), 6) AS min_idf, round(max(idf), 6) AS max_idf, round(median(idf), 6) AS median_idf FROM idf")
def idf_stats(spark, d):
    return _rounded(stats.idf_stats(stats.idf_table(C.documents(spark, d))))


@query(f"WITH {S.USERS}, {S.tok()}, {S.gram(3)}, {S.idf(form='df')} SELECT gram, df, round(idf, 6) AS idf FROM idf ORDER BY idf.idf DESC, gram LIMIT 20")
def top_ngrams_by_idf(spark, d):
    return stats.top_by_idf(stats.idf_table(C.users(spark, d), 3, stats.plain_idf).select(_name(), "df", "idf")).select("gram", "df", _r("idf"))


@query(f"WITH {S.DOCS}, {S.ITEMS} SELECT round((SELECT avg(len(tokens)) FROM items) / (SELECT avg(len(tokens)) FROM docs), 6) AS rho")
def length_ratio(spark, d):
    return _rounded(stats.length_ratio(C.benchmark(spark, d), C.documents(spark, d)))


@query(f"WITH {S.DOCS} SELECT lang, count(*) AS n, sum(len(tokens))::BIGINT AS n_tokens, round(avg(len(tokens)), 6) AS mean_len FROM docs JOIN documents ON doc_id = doc_idx GROUP BY lang")
def per_language_stats(spark, d):
    rows = C.table(spark, d, "documents").select("lang", F.size(C.words(F.coalesce("text", F.lit("")))).alias("n"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("mean_len"))


# association


@query(f"WITH {S.DOCS}, {S.tok()}, {S.PMI} SELECT a, b, cnt, round(pmi, 6) AS pmi FROM pmi")
def pmi_scores(spark, d):
    return pmi.pmi(C.documents(spark, d)).select("a", "b", "cnt", _r("pmi"))


@query(f"WITH {S.USERS}, {S.tok()}, {S.PMI} SELECT a, b, cnt, round(pmi, 6) AS pmi FROM pmi")
def pmi_events(spark, d):
    return pmi.pmi(C.users(spark, d)).select("a", "b", "cnt", _r("pmi"))


@query(f"WITH {S.DOCS}, {S.tok()}, {S.PMI} SELECT a || ' ' || b AS gram, cnt, round(pmi, 6) AS pmi FROM pmi WHERE pmi > 0.5")
def pmi_selected(spark, d):
    return pmi.selected_pairs(pmi.pmi(C.documents(spark, d)), 0.5).select(_name(), "cnt", _r("pmi"))


# weights


@query(f"WITH {S.unigram()} SELECT doc_idx, gram, round(w, 6) AS w FROM dw")
def tfidf_unigram_weights(spark, d):
    docs = C.documents(spark, d)
    return tfidf.UnigramModel.fit(docs).weights(docs).select("doc_idx", _name(), _r("w"))


@query(f"WITH {S.unigram(S.USERS, S.SLICES)} SELECT query_idx, gram, round(w, 6) AS w FROM qw")
def tfidf_query_weights(spark, d):
    docs = C.users(spark, d)
    return tfidf.UnigramModel.fit(docs).weights(C.slices(docs), "query_idx").select("query_idx", _name(), _r("w"))


@query(f"WITH {S.paired()} SELECT doc_idx, gram, round(w, 6) AS w FROM dw")
def tfidf_pmi_weights(spark, d):
    docs = C.documents(spark, d)
    return tfidf.PairModel.fit(docs).weights(docs).select("doc_idx", _name(), _r("w"))


_MIXED = ", ".join(
    [S.USERS, S.tok()]
    + [x for n in (1, 2, 3) for x in (S.gram(n, name=f"g{n}"), S.idf(f"g{n}", f"i{n}", "df"), S.weights(f"g{n}", f"(SELECT * FROM i{n} WHERE idf <> 0)", n, "doc_idx", f"w{n}", f"(1 / sqrt({n}))"))]
)


@query(f"WITH {_MIXED} SELECT doc_idx, gram, round(w, 6) AS w FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)")
def tfidf_mixed_ngram(spark, d):
    docs = C.users(spark, d)
    return tfidf.MixedModel.fit(docs).weights(docs).select("doc_idx", _name(), _r("w"))


# search

_TOP = "SELECT query_idx, doc_idx, round(sim, 6) AS sim, rank AS cand_rank FROM by_sim WHERE rank <= {n}"


def _top(spark, d, system):
    docs, items = C.documents(spark, d), C.benchmark(spark, d)
    return candidates(docs, items, system).select("query_idx", "doc_idx", _r("sim"), "cand_rank")


@query(f"WITH {S.unigram()}, {S.EVERY}, {S.BY_SIM} {_TOP.format(n=10)}")
def cosine_topk_unigram(spark, d):
    return _top(spark, d, System("tfidf", candidates=10))


@query(f"WITH {S.paired()}, {S.EVERY}, {S.BY_SIM} {_TOP.format(n=10)}")
def cosine_topk_pmi(spark, d):
    return _top(spark, d, System("paired", tau=0.5, candidates=10))


@query(f"WITH {S.unigram(S.USERS, S.SLICES)}, {S.EVERY}, {S.BY_SIM} SELECT query_idx, doc_idx, round(sim, 6) AS sim, rank FROM by_sim")
def cosine_full_rank(spark, d):
    docs = C.users(spark, d)
    return ranking(docs, C.slices(docs), System("tfidf")).select("query_idx", "doc_idx", _r("sim"), "rank")


_KNN = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
s AS (SELECT q.vec_id AS query_idx, d.vec_id AS doc_idx, round(list_cosine_similarity(q.vec, d.vec), 9) AS sim FROM v q CROSS JOIN v d WHERE q.vec_id % 25 = 0)
SELECT query_idx, doc_idx, round(sim, 6) AS sim, cand_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY sim DESC, doc_idx) AS cand_rank FROM s) WHERE cand_rank <= 10"""


def _vectors(spark, d):
    rows = C.frames(spark, d).select(F.col("vec_id").alias("doc_idx"), "vec")
    return rows.where("doc_idx % 25 = 0").withColumnRenamed("doc_idx", "query_idx"), rows


@query(_KNN)
def embedding_knn(spark, d):
    return similarity.dense_knn(*_vectors(spark, d), 10).select("query_idx", "doc_idx", _r("sim"), "cand_rank")


@query()
def embedding_knn_ivf(spark, d):
    """Approximate neighbours; what is found depends on the centroids."""
    return similarity.ivf_knn(*_vectors(spark, d), 10).select("query_idx", "doc_idx", _r("sim"), "cand_rank")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)
SELECT a.vec_id, round(1 - list_cosine_similarity(a.vec, b.vec), 6) AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def cosine_distances(spark, d):
    a = C.frames(spark, d).select("vec_id", "vec")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(similarity.cosine_distance(F.col("vec"), F.col("other")), 6).alias("distance"))


# alignment

_PAIRS = "cand AS (SELECT query_idx, doc_idx FROM items CROSS JOIN docs)"
_SLICED = ", ".join([S.USERS, S.SLICES, S.tok(), S.tok("items", "query_idx", "qtok"), _PAIRS])


def _sliced(spark, d):
    docs = C.users(spark, d)
    return C.slices(docs), docs


@query(f"WITH RECURSIVE {_SLICED}, {S.local_alignment()} SELECT query_idx, doc_idx, round(best / 5, 6) AS score FROM best")
def sw_scores(spark, d):
    return grid.alignment_scores(*_sliced(spark, d), digits=6, score="query")


@query(f"WITH RECURSIVE {_SLICED}, {S.local_alignment()} SELECT query_idx, doc_idx, round(best / (2.0 * 5), 6) AS score, best AS raw FROM best")
def sw_scores_normalised(spark, d):
    return grid.alignment_scores(*_sliced(spark, d), digits=6, score="best", raw="raw")


@query(f"WITH RECURSIVE {_SLICED}, {S.warping()} SELECT query_idx, doc_idx, round(cost / (5 + len(tokens)), 6) AS distance FROM costs JOIN docs USING (doc_idx)")
def dtw_scores(spark, d):
    return grid.warping_distances(*_sliced(spark, d), digits=6)


@query(f"WITH RECURSIVE {_SLICED}, {S.warping()} SELECT query_idx, doc_idx, row_number() OVER (PARTITION BY query_idx ORDER BY round(cost / (5 + len(tokens)), 9), doc_idx) AS rank FROM costs JOIN docs USING (doc_idx)")
def dtw_rank(spark, d):
    docs = C.users(spark, d)
    return rank.by_warping(C.slices(docs), docs, distances=False).select("query_idx", "doc_idx", "rank")


@query()
def dtw_rank_sampled(spark, d):
    """Only a seeded sample of documents is measured; the sample is this engine's own."""
    docs = C.users(spark, d)
    return rank.by_warping(C.slices(docs), docs, max_docs=50, distances=False).select("query_idx", "doc_idx", "rank")


# systems


def _front(base: str, n: int = FEW) -> str:
    return f"{base}, {S.EVERY}, {S.BY_SIM}, cand AS (SELECT query_idx, doc_idx, sim FROM by_sim WHERE rank <= {n}), {S.local_alignment()}"


_FULL = "ranked AS (SELECT p.query_idx, p.doc_idx, p.sim, best / 5 AS sw, row_number() OVER (PARTITION BY p.query_idx ORDER BY best IS NULL, best / 5 DESC NULLS LAST, p.sim DESC, p.doc_idx) AS rank FROM pairs_all p LEFT JOIN best USING (query_idx, doc_idx))"


def _sliced_system(spark, d, system):
    docs = C.users(spark, d)
    return docs, C.slices(docs), system


@query(f"WITH RECURSIVE {_front(S.unigram(S.USERS, S.SLICES))}, {_FULL} SELECT query_idx, doc_idx, round(sw, 6) AS sw, rank FROM ranked WHERE sw IS NOT NULL")
def rerank_topc(spark, d):
    docs, q, system = _sliced_system(spark, d, System("aligned", candidates=FEW))
    return ranking(docs, q, system, full=False).select("query_idx", "doc_idx", _r("sw"), "rank")


@query(f"WITH RECURSIVE {_front(S.unigram(S.USERS, S.SLICES))}, {_FULL} SELECT query_idx, doc_idx, rank FROM ranked")
def aligned_full_rank(spark, d):
    docs, q, system = _sliced_system(spark, d, System("aligned", candidates=FEW))
    return ranking(docs, q, system, scores=False).select("query_idx", "doc_idx", "rank")


@query(f"WITH RECURSIVE {_front(S.paired(S.USERS, S.SLICES, tau=0.0))}, {_FULL} SELECT query_idx, doc_idx, rank FROM ranked")
def paired_full_rank(spark, d):
    docs, q, system = _sliced_system(spark, d, System("paired", tau=0.0, candidates=FEW))
    return ranking(docs, q, system, scores=False).select("query_idx", "doc_idx", "rank")


@query(f"WITH {S.paired(S.USERS, S.SLICES, tau=0.0)}, {S.EVERY}, {S.BY_SIM} SELECT query_idx, doc_idx, rank FROM by_sim")
def paired_cosine_rank(spark, d):
    docs, q, system = _sliced_system(spark, d, System("paired_cosine", tau=0.0))
    return ranking(docs, q, system, scores=False).select("query_idx", "doc_idx", "rank")


@query()
def paired_rerank_documents(spark, d):
    """The flagship over words: PMI-weighted candidates of every benchmark item, re-ranked by alignment."""
    docs, items = C.documents(spark, d), C.benchmark(spark, d)
    system = System("paired", tau=0.5, candidates=CANDIDATES)
    (sims,) = shared_similarities(docs, items, [system])
    return ranking(docs, items, system, sims, full=False).select("query_idx", "doc_idx", _r("sim"), _r("sw"), "rank")


@query(f"WITH {S.unigram()}, {S.EVERY}, {S.BY_SIM} SELECT query_idx, doc_idx, rank - 10 AS tail_rank FROM by_sim WHERE rank > 10")
def tail_antijoin(spark, d):
    docs, items = C.documents(spark, d), C.benchmark(spark, d)
    sims = similarities(docs, items, System("tfidf"))
    front = similarity.top_candidates(sims, items, docs, 10)
    return rank.tail(front, sims, items, docs).select("query_idx", "doc_idx", "tail_rank")


# ground truth and keys


@query(f"WITH {S.TRUTH} SELECT * FROM truth")
def ground_truth_join(spark, d):
    return C.contained(spark, d)


@query(f"WITH {S.USERS}, {S.SLICES}, {S.tok()}, {S.gram(5)} SELECT DISTINCT query_idx, g.doc_idx FROM gram g JOIN items ON g.gram = array_to_string(items.tokens, ' ')")
def verbatim_truth(spark, d):
    docs = C.users(spark, d)
    return groundtruth.verbatim_truth(C.slices(docs), docs)


@query(f"WITH {S.TRUTH}, n AS (SELECT query_idx, count(*) AS c FROM truth GROUP BY query_idx) SELECT count(*) AS n_queries, count(c) AS n_with_truth, coalesce(sum(c), 0)::BIGINT AS n_pairs FROM benchmark LEFT JOIN n ON query_idx = item_id")
def truth_coverage(spark, d):
    return groundtruth.coverage(C.benchmark(spark, d), C.contained(spark, d))


@query("""WITH s AS (SELECT page_id, list_extract(string_split(rtrim(url, '/'), '/'), -1) AS name FROM pages),
t AS (SELECT page_id, regexp_replace(name, '^(.+)\\.[^.]+$', '\\1') AS stem FROM s)
SELECT page_id, stem, list_extract(string_split(stem, '_'), -1) AS suffix, stem || '_l3_k' || CAST(page_id AS VARCHAR) AS tag FROM t""")
def path_keys(spark, d):
    pages = C.table(spark, d, "pages")
    tag = config_tag(path_stem("url"), F.lit(3), F.col("page_id"))
    return pages.select("page_id", path_stem("url").alias("stem"), normalized_id("url").alias("suffix"), tag.alias("tag"))


_FALLBACK = """WITH q AS (SELECT item_id AS query_idx, CASE WHEN item_id % 2 = 0 THEN 'q_' ELSE 'x_' END || (item_id % 7) AS stem FROM benchmark),
c AS (SELECT doc_id AS doc_idx, 'd_' || doc_id AS stem FROM documents),
rel AS (SELECT 'q_' || (doc_id % 5) AS query_stem, 'd_' || doc_id AS doc_stem, doc_id % 5 AS key_order FROM documents WHERE doc_id < 50
  UNION ALL SELECT 'r_' || (doc_id % 7), 'd_' || doc_id, 10 + doc_id % 7 FROM documents WHERE doc_id BETWEEN 50 AND 90),
keys AS (SELECT query_stem, max(key_order) AS o FROM rel GROUP BY query_stem),
last AS (SELECT list_extract(string_split(query_stem, '_'), -1) AS suffix, arg_max(query_stem, o) AS fallback FROM keys GROUP BY 1),
chosen AS (SELECT query_idx, coalesce(k.query_stem, l.fallback) AS query_stem FROM q LEFT JOIN keys k ON k.query_stem = q.stem LEFT JOIN last l ON l.suffix = list_extract(string_split(q.stem, '_'), -1))
SELECT DISTINCT query_idx, doc_idx FROM chosen JOIN rel USING (query_stem) JOIN c ON c.stem = rel.doc_stem"""


@query(_FALLBACK)
def suffix_fallback(spark, d):
    items, docs = C.table(spark, d, "benchmark"), C.table(spark, d, "documents")
    n = F.col("item_id")
    queries = items.select(n.alias("query_idx"), F.concat(F.when(n % 2 == 0, "q_").otherwise("x_"), (n % 7).cast("string")).alias("stem"))
    k = F.col("doc_id")
    corpus = docs.select(k.alias("doc_idx"), F.concat(F.lit("d_"), k.cast("string")).alias("stem"))

    def rel(prefix, part, order, where):
        return docs.where(where).select(F.concat(F.lit(prefix), part.cast("string")).alias("query_stem"), F.concat(F.lit("d_"), k.cast("string")).alias("doc_stem"), order.cast("int").alias("key_order"))

    relevance = rel("q_", k % 5, k % 5, k < 50).unionByName(rel("r_", k % 7, k % 7 + 10, k.between(50, 90)))
    return groundtruth.ground_truth(queries, corpus, relevance)


# metrics

_METRICS = "SELECT map, mrr, p_at_1, p_at_5, p_at_10 FROM scores"
_BENCH = f"WITH {S.unigram()}, {S.EVERY}, {S.BY_SIM}, {S.TRUTH}"
#: What the relevance names: odd items alone, one of three of them with an empty list, one document more than found.
_NAMED = "SELECT item_id AS query_idx, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 + (SELECT count(*) FROM truth t WHERE t.query_idx = item_id) END AS n_rel FROM benchmark WHERE item_id % 2 = 1"


def _bench(spark, d):
    docs, items = C.documents(spark, d), C.benchmark(spark, d)
    # a few pairs, which ranks and metrics read several times
    return docs, items, C.contained(spark, d).persist()


def _modes(spark, d, mode):
    docs, items, truth = _bench(spark, d)
    n = truth.groupBy("query_idx").agg(F.count(F.lit(1)).alias("_n"))
    odd = items.where("query_idx % 2 = 1").select("query_idx").join(n, "query_idx", "left")
    named = odd.select("query_idx", F.when(F.col("query_idx") % 3 == 0, 0).otherwise(1 + F.coalesce("_n", F.lit(0))).alias("n_rel"))
    order = truth_ranks(docs, items, truth, System("tfidf"))
    # an item with an empty list has no relevant document
    truth = truth.join(named.where("n_rel > 0").select("query_idx"), "query_idx", "left_semi")
    return _rounded(metrics.evaluate(order, truth, items, mode, named))


@query(f"{_BENCH}, {S.metrics('by_sim')} {_METRICS}")
def eval_core(spark, d):
    docs, items, truth = _bench(spark, d)
    return _rounded(metrics.evaluate(truth_ranks(docs, items, truth, System("tfidf")), truth, items))


_NAMED_TRUTH = f"named AS ({_NAMED}), truth2 AS (SELECT t.* FROM truth t JOIN named n ON n.query_idx = t.query_idx AND n.n_rel > 0)"


@query(f"{_BENCH}, {_NAMED_TRUTH}, {S.metrics('by_sim', 'truth2', 'SELECT query_idx FROM named', 'SELECT query_idx, n_rel FROM named')} {_METRICS}")
def eval_multi(spark, d):
    return _modes(spark, d, "multi")


@query(f"{_BENCH}, {_NAMED_TRUTH}, {S.metrics('by_sim', 'truth2', 'SELECT query_idx FROM named WHERE n_rel > 0', 'SELECT query_idx, n_rel FROM named')} {_METRICS}")
def eval_strict(spark, d):
    return _modes(spark, d, "strict")


_MTWV = """WITH s AS (SELECT CAST(length(text) % 997 AS DOUBLE) / 997 AS score, quality AS label FROM labels JOIN documents USING (doc_id)),
b AS (SELECT min(score) AS lo, max(score) AS hi, sum(label)::BIGINT AS n_true, count(*) - sum(label)::BIGINT AS n_false FROM s),
th AS (SELECT i, CASE WHEN i = 299 THEN hi ELSE lo + i * ((hi - lo) / 299) END AS theta FROM b, generate_series(0, 299) g(i)),
v AS (SELECT i, count(*) FILTER (label = 1 AND score < theta) AS miss, count(*) FILTER (label = 0 AND score >= theta) AS fa FROM th CROSS JOIN s GROUP BY i),
r AS (SELECT i, miss / CAST(n_true AS DOUBLE) AS p_miss, fa / CAST(greatest(n_false, 1) AS DOUBLE) AS p_fa, n_true, n_false, n_false / CAST(n_true AS DOUBLE) AS beta FROM v CROSS JOIN b)
SELECT round(1 - (p_miss + beta * p_fa), 6) AS mtwv, round(p_miss, 6) AS p_miss, round(p_fa, 6) AS p_fa, n_true, n_false, round(beta, 6) AS beta FROM r ORDER BY round(1 - (p_miss + beta * p_fa), 12) DESC, i LIMIT 1"""


@query(_MTWV)
def mtwv(spark, d):
    length = C.table(spark, d, "documents").select("doc_id", (F.length("text") % 997 / 997.0).cast("double").alias("score"))
    scores = C.table(spark, d, "labels").join(length, "doc_id").select("score", F.col("quality").alias("label"))
    return _rounded(metrics.mtwv(scores), "n_true", "n_false")


# merging

_CODED_TEXT = "s0 AS (SELECT doc_idx, list_aggregate(list_transform(tokens, lambda t: ' ' || t || ' '), 'string_agg', '') AS s, len(tokens) AS n FROM docs)"


def _merged(n: int) -> str:
    e = "s"
    for a, b, new in MERGES[:n]:
        e = f"replace({e}, ' {a}  {b} ', ' {new} ')"
    return e


@query(f"WITH {S.CODED}, {S.tok()}, p AS (SELECT doc_idx, pos, t AS a, lead(t) OVER (PARTITION BY doc_idx ORDER BY pos) AS b FROM tok), c AS (SELECT a, b, count(*) AS cnt, min(doc_idx * 100000 + pos) AS first FROM p WHERE b IS NOT NULL GROUP BY a, b) SELECT a::INT AS a, b::INT AS b, cnt FROM c ORDER BY cnt DESC, first LIMIT 1")
def bpe_pair_argmax(spark, d):
    return bpe.most_frequent_pair(C.coded_users(spark, d)).select("a", "b", "cnt")


@query(f"WITH {S.CODED}, {_CODED_TEXT} SELECT doc_idx, trim(replace({_merged(4)}, '  ', ' ')) AS tokens FROM s0")
def bpe_apply_merges(spark, d):
    return bpe.encode(C.coded_users(spark, d), MERGES).select("doc_idx", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


_FREQ = " UNION ALL ".join(
    f"SELECT {i} AS step, {a} AS a, {b} AS b, {new} AS new_id, coalesce(sum((SELECT count(*) FROM (SELECT unnest(list_zip(l[:-2], l[2:])) AS z) WHERE z[1] = '{a}' AND z[2] = '{b}')), 0)::BIGINT AS cnt FROM (SELECT string_split(trim(replace({_merged(i)}, '  ', ' ')), ' ') AS l FROM s0)"
    for i, (a, b, new) in enumerate(MERGES)
)


@query(f"WITH {S.CODED}, {_CODED_TEXT} SELECT CAST(step AS BIGINT) AS step, a, b, new_id, cnt FROM ({_FREQ})")
def bpe_merge_frequencies(spark, d):
    return bpe.merge_frequencies(C.coded_users(spark, d), MERGES)


@query(f"WITH {S.CODED}, {_CODED_TEXT} SELECT round(avg(len(string_split(trim(replace({_merged(4)}, '  ', ' ')), ' ')) / CAST(n AS DOUBLE)), 6) AS ratio FROM s0 WHERE n > 0")
def bpe_compression(spark, d):
    docs = C.coded_users(spark, d)
    return _rounded(bpe.compression_ratio(docs, bpe.encode(docs, MERGES)))


def _learned(steps: int) -> str:
    """The steps of learning one after the other: the best pair of a state, and the state with it merged."""
    ctes, rows = [S.CODED, _CODED_TEXT], []
    for i in range(steps):
        ctes += [
            f"t{i} AS MATERIALIZED (SELECT doc_idx, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (SELECT doc_idx, string_split(trim(replace(s, '  ', ' ')), ' ') AS l FROM s{i} WHERE s <> ''))",
            f"p{i} AS (SELECT doc_idx, pos, t AS a, lead(t) OVER (PARTITION BY doc_idx ORDER BY pos) AS b FROM t{i})",
            f"b{i} AS MATERIALIZED (SELECT a, b, count(*) AS cnt, min(doc_idx * 100000 + pos) AS first, (SELECT count(*) FROM types) + {i} AS new_id FROM p{i} WHERE b IS NOT NULL GROUP BY a, b HAVING count(*) >= 2 ORDER BY cnt DESC, first LIMIT 1)",
            f"s{i + 1} AS MATERIALIZED (SELECT doc_idx, replace(s, ' ' || a || '  ' || b || ' ', ' ' || new_id || ' ') AS s FROM s{i} CROSS JOIN b{i})",
        ]
        rows.append(f"SELECT CAST({i} AS BIGINT) AS step, CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(new_id AS INT) AS new_id, cnt FROM b{i}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(rows)}"


@query(_learned(6))
def bpe_fit_k(spark, d):
    """Learned merges; each step depends on the one before."""
    return bpe.fit(C.coded_users(spark, d), 6).table(spark)


@query(_learned(12))
def bpe_fit_past_a_written_state(spark, d):
    """More merges than there are between two written states."""
    return bpe.fit(C.coded_users(spark, d), bpe.WRITE_EVERY + 2).table(spark)


# quantisation

_MEANS = """m AS (SELECT token, list(m ORDER BY pos) AS centroid FROM (SELECT label AS token, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY token),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
a AS (SELECT vec_id, arg_min(token, struct_pack(d := round(list_distance(vec, centroid) ** 2, 9), t := token)) AS token FROM v CROSS JOIN m GROUP BY vec_id)"""


@query(f"WITH {_MEANS} SELECT vec_id, token FROM a")
def nearest_centroid_tokens(spark, d):
    frames = C.frames(spark, d)
    return quantize.assign(frames, quantize.centroid_means(frames, "label")).select("vec_id", "token")


@query(f"WITH {_MEANS} SELECT vec_id // 25 AS doc_idx, string_agg(CAST(token AS VARCHAR), ' ' ORDER BY vec_id) AS tokens FROM a GROUP BY 1")
def quantised_sequences(spark, d):
    frames = C.frames(spark, d)
    tokens = quantize.assign(frames, quantize.centroid_means(frames, "label")).withColumn("doc", F.floor(F.col("vec_id") / 25).cast("long"))
    return quantize.token_sequences(tokens, "doc", "vec_id").select("doc_idx", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


@query()
def kmeans_tokens(spark, d):
    """Tokens by fitted centroids, whose places depend on the seeding."""
    frames = C.frames(spark, d)
    return quantize.assign(frames, quantize.fit_centroids(frames, 8)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# sweeps


def _point(system: System) -> str:
    base = S.unigram() if system.tau is None else S.paired(tau=system.tau, alpha=system.alpha)
    tau = "NULL" if system.tau is None else system.tau
    return f"(WITH {base}, {S.EVERY}, {S.BY_SIM}, {S.TRUTH}, {S.metrics('by_sim')} SELECT '{system.name}' AS system, CAST({tau} AS DOUBLE) AS tau, CAST({system.alpha} AS DOUBLE) AS alpha, map, mrr, p_at_1, p_at_5, p_at_10 FROM scores)"


_GRID = [System("a", None), System("b", 0.5, 0.5), System("c", 1.5, 1.0)]


def _grid(spark, d):
    docs, items, truth = _bench(spark, d)
    out = None
    for s, ranks in zip(_GRID, shared_ranks(docs, items, truth, _GRID)):
        row = evaluated(docs, items, truth, s, ranks=ranks).drop("candidates")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT * FROM (" + " UNION ALL ".join(_point(s) for s in _GRID) + ")")
def alpha_tau_sweep(spark, d):
    return _rounded(_grid(spark, d), "system", "tau", "alpha")


@query("SELECT x.system, round((x.map - y.map) / greatest(y.map, 1e-9), 4) AS map_gain, round((x.mrr - y.mrr) / greatest(y.mrr, 1e-9), 4) AS mrr_gain FROM (" + " UNION ALL ".join(_point(s) for s in _GRID[1:]) + f") x CROSS JOIN ({_point(_GRID[0])}) y")
def gain_vs_baseline(spark, d):
    rows = _rounded(_grid(spark, d), "system", "tau", "alpha")
    base = rows.where("system = 'a'").select(F.col("map").alias("map0"), F.col("mrr").alias("mrr0"))
    others = rows.where("system != 'a'").crossJoin(F.broadcast(base))
    return others.select("system", F.round(relative_gain("map", "map0"), 4).alias("map_gain"), F.round(relative_gain("mrr", "mrr0"), 4).alias("mrr_gain"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_rerank_documents(spark, sf_dir)
