"""Preparation of a benchmark from its annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import annotations, sinks


def prepared(excerpts: DataFrame, terms: DataFrame, doc_files: DataFrame, query_files: DataFrame, occurrences: DataFrame | None) -> dict[str, DataFrame]:
    """``corpus`` and ``queries`` (``stem``, ``path``; only those with a file), ``relevance`` (``query_stem``,
    ``doc_stem``), ``pairs`` (every query with every document)."""
    corpus = excerpts.join(doc_files.select("stem", "path"), "stem").select("stem", "path")
    queries = terms.join(query_files.select("stem", "path"), "stem").select("stem", "path")
    if occurrences is None:
        relevance = queries.select(F.col("stem").alias("query_stem"), F.col("stem").alias("doc_stem")).limit(0)
    else:
        relevance = occurrences.select(F.col("term").alias("query_stem"), F.col("doc").alias("doc_stem"))
    pairs = queries.select(F.col("stem").alias("query_stem")).crossJoin(corpus.select(F.col("stem").alias("doc_stem")))
    return {"corpus": corpus, "queries": queries, "relevance": relevance, "pairs": pairs}


def manifest_row(parts: dict[str, DataFrame], lang: str, split: str, out: str) -> DataFrame:
    """Counts and places of a prepared language."""
    count = lambda name, alias: parts[name].agg(F.count(F.lit(1)).alias(alias))
    row = count("queries", "n_queries").crossJoin(count("corpus", "n_docs")).crossJoin(count("relevance", "n_positives"))
    return row.select(
        F.lit(lang).alias("lang"),
        F.lit(split).alias("split"),
        "n_queries",
        "n_docs",
        (F.col("n_queries") * F.col("n_docs")).alias("n_pairs"),
        "n_positives",
        (F.col("n_positives") > 0).alias("has_ground_truth"),
        *(F.lit(f"{out}/{name}").alias(alias) for name, alias in (("corpus_files", "corpus_csv"), ("query_files", "query_csv"), ("relevance", "relevance_json"), ("all_pairs", "pairs_json"))),
    )


def prepare_language(spark: SparkSession, lang: str, folder: str, split: str, out: str) -> DataFrame:
    """Read a language's annotation files, write its lists below ``out``, return its manifest row.

    Layout: ``Audio``, ``dev_queries`` or ``eval_queries``, and ``scoring/<split>`` with the .ecf.xml, .tlist.xml and
    perhaps .rttm file of the language."""
    scoring = f"{folder}/scoring/{split}/{lang}"
    occurrences = annotations.read_occurrences(spark, f"{scoring}.rttm") if _exists(spark, f"{scoring}.rttm") else None
    queries = f"{folder}/{'dev' if split == 'dev' else 'eval'}_queries"
    parts = prepared(
        annotations.read_excerpts(spark, f"{scoring}.ecf.xml"),
        annotations.read_terms(spark, f"{scoring}.tlist.xml"),
        annotations.audio_files(spark, f"{folder}/Audio"),
        annotations.audio_files(spark, queries),
        occurrences,
    )
    to = f"{out}/{lang}/{split}"
    sinks.write_file_list(parts["corpus"], f"{to}/corpus_files")
    sinks.write_file_list(parts["queries"], f"{to}/query_files")
    sinks.write_relevance(parts["relevance"], f"{to}/relevance")
    sinks.write_pairs(parts["pairs"], f"{to}/all_pairs")
    return manifest_row(parts, lang, split, to)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


