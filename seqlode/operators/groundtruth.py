"""Which documents are relevant to which query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import path_stem, suffix_key
from ..functions.ngrams import ngrams


def ground_truth(queries: DataFrame, docs: DataFrame, relevance: DataFrame) -> DataFrame:
    """``query_idx``, ``doc_idx``, distinct.

    ``queries`` and ``docs`` have an index and ``stem``; ``relevance`` has ``query_stem``, ``doc_stem`` and
    ``key_order``. A query without a key of its own takes the last key with the same suffix. Relevant documents that
    the corpus lacks are dropped; their stems are taken once more, so a stem with a dot finds nothing."""
    keys = relevance.groupBy("query_stem").agg(F.max("key_order").alias("_o"))
    by_suffix = keys.groupBy(suffix_key("query_stem").alias("_suffix")).agg(F.max_by("query_stem", "_o").alias("_fallback"))
    own = queries.select("query_idx", F.col("stem").alias("_q"), suffix_key("stem").alias("_suffix"))
    found = own.join(keys.select(F.col("query_stem").alias("_key")), F.col("_q") == F.col("_key"), "left").join(by_suffix, "_suffix", "left")
    chosen = found.select("query_idx", F.coalesce("_key", "_fallback").alias("query_stem"))
    pairs = chosen.join(relevance.select("query_stem", path_stem("doc_stem").alias("stem")), "query_stem")
    return pairs.join(docs.select("doc_idx", "stem"), "stem").select("query_idx", "doc_idx").distinct()


def verbatim_truth(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that hold the query's tokens as a run: ``query_idx``, ``doc_idx``.

    Each query length is joined on its n-grams, so no query meets a document it does not occur in."""
    q = queries.select("query_idx", "tokens", F.size("tokens").alias("n")).where("n > 0")
    lengths = [r["n"] for r in q.select("n").distinct().collect()]
    out = None
    for n in sorted(lengths):
        grams = docs.select("doc_idx", F.explode(F.array_distinct(ngrams("tokens", n))).alias("tokens"))
        found = q.where(F.col("n") == n).join(grams, "tokens").select("query_idx", "doc_idx")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else q.select("query_idx", F.lit(None).cast("long").alias("doc_idx")).limit(0)


def coverage(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: ``n_queries``, ``n_with_truth``, ``n_pairs``."""
    n = truth.groupBy("query_idx").agg(F.count(F.lit(1)).alias("_n"))
    joined = queries.select("query_idx").join(n, "query_idx", "left")
    return joined.agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("_n") > 0).alias("n_with_truth"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_pairs"))
