"""Counts, document frequencies and sequence statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indexing import dense_index
from ..functions.ngrams import ngrams


def exploded(docs: DataFrame, n: int = 1, *keep: str) -> DataFrame:
    """A row per n-gram occurrence: ``gram`` and the columns kept."""
    return docs.select(*keep, F.explode(ngrams("tokens", n)).alias("gram"))


def gram_counts(docs: DataFrame, n: int = 1) -> DataFrame:
    """Occurrences of each n-gram in the corpus: ``gram``, ``cnt``."""
    return exploded(docs, n).groupBy("gram").agg(F.count(F.lit(1)).alias("cnt"))


def term_counts(docs: DataFrame, n: int = 1, id_col: str = "doc_idx") -> DataFrame:
    """Occurrences of each n-gram in each document: ``id_col``, ``length`` (tokens of the document), ``gram``, ``cnt``.

    Documents are dealt by id first, as whole token arrays; the counting then needs no further exchange, nor does
    what follows by document."""
    rows = docs.repartition(id_col).select(id_col, F.size("tokens").alias("length"), F.explode(ngrams("tokens", n)).alias("gram"))
    return rows.groupBy(id_col, "gram").agg(F.first("length").alias("length"), F.count(F.lit(1)).alias("cnt"))


def document_frequency(docs: DataFrame, n: int = 1) -> DataFrame:
    """Documents that hold each n-gram: ``gram``, ``df``."""
    return docs.select(F.explode(F.array_distinct(ngrams("tokens", n))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def gram_table(docs: DataFrame, n: int = 1) -> DataFrame:
    """Occurrences and documents of each n-gram from one count by document: ``gram``, ``cnt``, ``df``. Beside other uses of
    ``term_counts`` the documents are tokenised and dealt once (Spark reuses the exchange)."""
    return term_counts(docs, n).groupBy("gram").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("df"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: documents ``n_docs``, tokens ``n_tok``, adjacent pairs ``n_bi``."""
    length = F.size("tokens").cast("long")
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum(length), F.lit(0)).alias("n_tok"),
        F.coalesce(F.sum(F.greatest(length - 1, F.lit(0))), F.lit(0)).alias("n_bi"),
    )


def smoothed_idf(n_docs: Column, df: Column) -> Column:
    """ln(N / (1 + df)): zero at N - 1 documents, negative if all hold it."""
    return F.ln(n_docs / (1 + df))


def plain_idf(n_docs: Column, df: Column) -> Column:
    return F.ln(n_docs / df)


def idf_table(docs: DataFrame, n: int = 1, idf=smoothed_idf, counted: DataFrame | None = None) -> DataFrame:
    """``gram``, ``df``, ``idf``; of the n-grams of ``counted`` (``gram``, ``df``), if that is given."""
    df = document_frequency(docs, n) if counted is None else counted
    total = docs.agg(F.count(F.lit(1)).alias("_n"))
    return df.crossJoin(F.broadcast(total)).select("gram", "df", idf(F.col("_n"), F.col("df")).alias("idf"))


def numbered(vocabulary: DataFrame, start: int = 0) -> DataFrame:
    """Dense column numbers in gram order, beginning at ``start``: ``gram``, ``column``."""
    return dense_index(vocabulary.select("gram").distinct(), ["gram"], "column", start)


def sequence_stats(docs: DataFrame) -> DataFrame:
    """One row: ``n``, ``min_len``, ``max_len``, ``mean_len``, ``std_len`` (population), ``vocab_size``.

    Distinct tokens are counted within rows first, then over the corpus."""
    length = F.size("tokens")
    sizes = docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(length).cast("long").alias("min_len"),
        F.max(length).cast("long").alias("max_len"),
        F.avg(length).alias("mean_len"),
        F.stddev_pop(length).alias("std_len"),
    )
    vocab = docs.select(F.explode(F.array_distinct("tokens")).alias("t")).distinct().agg(F.count(F.lit(1)).alias("vocab_size"))
    return sizes.crossJoin(F.broadcast(vocab))


def length_ratio(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: ``rho``, mean query length over mean document length."""
    q = queries.agg(F.avg(F.size("tokens")).alias("_q"))
    return docs.agg(F.avg(F.size("tokens")).alias("_d")).crossJoin(F.broadcast(q)).select((F.col("_q") / F.col("_d")).alias("rho"))


def idf_stats(idf: DataFrame) -> DataFrame:
    """One row: mean, population deviation, least, largest and median IDF."""
    return idf.agg(
        F.avg("idf").alias("mean_idf"), F.stddev_pop("idf").alias("std_idf"), F.min("idf").alias("min_idf"), F.max("idf").alias("max_idf"), F.median("idf").alias("median_idf")
    )


def top_by_idf(idf: DataFrame, n: int = 20) -> DataFrame:
    return idf.orderBy(F.desc("idf"), "gram").limit(n)
