"""Cosine similarity and nearest neighbours. All queries are ranked in one job.

Ties are ranked by document index; similarities are rounded to nine digits before ranking, so the order of summation
cannot change a rank."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantize import assign, fit_centroids, nearest_tokens

DIGITS = 9


def sparse_cosine(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_idx``, ``doc_idx``, ``sim`` of pairs that share an n-gram with weight; both sides are normalised
    weights, the queries' with ``query_idx``."""
    q = queries.where("w != 0").select("query_idx", "gram", F.col("w").alias("_q"))
    d = docs.where("w != 0").select("doc_idx", "gram", F.col("w").alias("_d"))
    return q.join(d, "gram").groupBy("query_idx", "doc_idx").agg(F.round(F.sum(F.col("_q") * F.col("_d")), DIGITS).alias("sim"))


def ranked(scores: DataFrame, rank: str, *order: Column) -> DataFrame:
    return scores.withColumn(rank, F.row_number().over(Window.partitionBy("query_idx").orderBy(*order)).cast("long"))


def top_candidates(sims: DataFrame, queries: DataFrame, docs: DataFrame, c: int) -> DataFrame:
    """The ``c`` most similar documents of every query: ``query_idx``, ``doc_idx``, ``sim``, ``cand_rank``.

    If fewer share an n-gram, documents of similarity 0 fill up, by index; all of those are among the first ``c``
    documents, so only these are paired with every query."""
    first = docs.select("doc_idx").orderBy("doc_idx").limit(c)
    fill = queries.select("query_idx").distinct().crossJoin(F.broadcast(first)).withColumn("sim", F.lit(0.0))
    both = sims.unionByName(fill).groupBy("query_idx", "doc_idx").agg(F.max("sim").alias("sim"))
    return ranked(both, "cand_rank", F.desc("sim"), F.asc("doc_idx")).where(F.col("cand_rank") <= c)


def all_pairs(sims: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Every query with every document, similarity 0 where they share nothing. The result has queries x documents
    rows, as a full ranking must."""
    every = docs.select("doc_idx").crossJoin(queries.select("query_idx").distinct())
    return every.join(sims, ["query_idx", "doc_idx"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of numeric arrays, 0 if one has norm zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; 1 if one vector has norm zero."""
    return 1 - dense_cosine(a, b)


def dense_knn(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Exact k nearest of dense vectors (``query_idx``/``doc_idx``, ``vec``) by cosine: a block nested loop over the
    query set, whose size is the caller's choice; ranks of each partition are cut to ``k`` before the exchange."""
    unit = _units(queries, "query_idx", "_q"), _units(docs, "doc_idx", "_d")
    return _nearest(unit[1].crossJoin(unit[0]), k)


def _units(rows: DataFrame, index: str, name: str, *more: str) -> DataFrame:
    """Vectors of length 1, so that a pair takes one product; one of norm zero becomes all zero."""
    x = F.col("vec").cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return rows.select(index, *more, norm.alias("_norm"), x.alias("_x")).select(index, *more, F.transform("_x", lambda v: F.when(F.col("_norm") == 0, F.lit(0.0)).otherwise(v / F.col("_norm"))).alias(name))


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    dot = F.aggregate(F.zip_with("_q", "_d", lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    scored = pairs.select("query_idx", "doc_idx", F.round(dot, DIGITS).alias("sim"))
    return ranked(scored, "cand_rank", F.desc("sim"), F.asc("doc_idx")).where(F.col("cand_rank") <= k)


#: Lists of the inverted file: about the root of the number of documents, at most this many.
MAX_LISTS = 4096
#: Queries that are searched exactly to learn how many lists the others need.
MEASURED = 64


def ivf_knn(queries: DataFrame, docs: DataFrame, k: int, lists: int | None = None, probes: int | None = None, recall: float = 0.95, seed: int = 42) -> DataFrame:
    """Approximate k nearest by cosine with an inverted file, columns as of ``dense_knn``.

    Centroids are fitted to a bounded sample of the documents (``fit_centroids``); every document is in the list of its
    nearest centroid, and a query looks into the ``probes`` nearest lists. Without ``probes`` it is so many as hold the
    share ``recall`` of the neighbours of MEASURED queries, chosen by a seeded hash and searched exactly. A query whose
    lists hold fewer than ``k`` documents is searched exactly too. A document is in one list, so a pair is scored once."""
    n = docs.count()
    lists = max(1, min(MAX_LISTS, int(n**0.5))) if lists is None else lists
    if n <= max(k, lists):
        return dense_knn(queries, docs, k)
    unit = _units(docs, "doc_idx", "vec")
    centroids = fit_centroids(unit, lists, seed)
    filed = assign(unit, centroids).select("token", "doc_idx", F.col("vec").alias("_d"))
    look = probes or _lists_needed(queries, docs, filed, centroids, k, lists, recall, seed)
    near = nearest_tokens(_units(queries, "query_idx", "vec"), centroids, look)
    probed = near.select("query_idx", F.col("vec").alias("_q"), F.explode("tokens").alias("token"))
    sizes = filed.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    few = probed.join(F.broadcast(sizes), "token").groupBy("query_idx").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= k)
    exact = queries.join(few, "query_idx", "left_anti")
    found = _nearest(probed.join(few.select("query_idx"), "query_idx", "left_semi").join(filed, "token"), k)
    return found.unionByName(dense_knn(exact, docs, k))


def _lists_needed(queries: DataFrame, docs: DataFrame, filed: DataFrame, centroids: DataFrame, k: int, lists: int, recall: float, seed: int) -> int:
    sample = queries.orderBy(F.xxhash64(F.lit(seed), "query_idx"), "query_idx").limit(MEASURED)
    order = nearest_tokens(_units(sample, "query_idx", "vec"), centroids, lists).select("query_idx", "tokens")
    found = dense_knn(sample, docs, k).join(filed.select("doc_idx", "token"), "doc_idx").join(order, "query_idx")
    need = found.agg(F.percentile(F.array_position("tokens", F.col("token")), F.lit(recall)).alias("n")).first()["n"]
    return lists if need is None else max(1, math.ceil(need))
