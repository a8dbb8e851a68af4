"""A corpus pipeline over ``documents``: language ID, exact dedup, near-duplicate join, source mix, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents. With ``documents`` empty every stage returns no row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlode.llm import bpe_codec, exact_dedup, language_id, mixing, ngram_join
from seqlode.llm.common import keep_rows, materialize, release, scratch, table, text_or_empty
from seqlode.llm.registry import tokenizer_files

#: A document whose best language scores less than this is in none of them.
MIN_SCORE = 0.25
#: One with less than this part of the familiar n-grams that are usual in its language is in none of them either.
MIN_FAMILIAR = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled rows teach; texts that are null, without a letter or unlike
    all of the languages go."""
    label, score, familiar = "_seqlode_label", "_seqlode_score", "_seqlode_familiar"
    out = language_id.identify(docs, language_id.train(docs), label_out=label, score_out=score, familiar_out=familiar)
    near = (F.col(score) >= MIN_SCORE) & (F.col(familiar) >= MIN_FAMILIAR)
    return out.where((F.col(label) != language_id.UNDETERMINED) & near).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest id stays, of rows with that id the
    first by a hash of all columns."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select("doc_id", "digest")
    digest = exact_dedup.sha256_digest(exact_dedup.fold_ascii(text_or_empty("text")))
    return keep_rows(docs, kept, {"doc_id": F.col("doc_id"), "digest": digest})


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least id; of rows with that id the one with
    the least hash of its text."""
    kept = ngram_join.ngram_join(docs).where("kept").select("doc_id", "text_hash")
    return keep_rows(docs, kept, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64(text_or_empty("text"))})


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times."""
    taken = mixing.mix(mixing.by_source(docs)).where("repeats > 0")
    taken = taken.groupBy(F.col("doc_id").alias("_seqlode_id"), F.col("size").alias("_seqlode_size")).agg(F.max("repeats").alias("_seqlode_repeats"))
    rows = docs.withColumn("_seqlode_words", mixing.word_count())
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("_seqlode_id")) & (F.col("_seqlode_words") == F.col("_seqlode_size")))
    return rows.withColumn("_seqlode_take", F.explode(F.sequence(F.lit(1), "_seqlode_repeats"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the token ids and of the bytes they decode to."""
    return bpe_codec.digests(bpe_codec.bpe_round_trip(docs.select("doc_id", "text"), *tokenizer_files()))


STAGES = [
    ("language_id", identified),
    ("exact_dedup", deduplicated),
    ("ngram_join", dissimilar),
    ("mixing", mixed),
    ("bpe_codec", encoded),
]

#: The first stage learns a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and what it has read, are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        read = docs
        with scratch() as keep:
            docs = keep(materialize(stage(spark, read, sf_dir), name))
        release(read)
    return STAGES[-1][1](spark, docs, sf_dir)
