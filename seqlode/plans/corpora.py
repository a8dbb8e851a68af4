"""Token corpora of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ngrams import ngrams
from ..functions.tokens import ordered_tokens, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt by ``key`` if its files give fewer tasks than there are cores (a small table in one row group);
    a table of many splits is left as it is."""
    return df.repartition(key) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents."""
    rows = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_idx"), "text"), "doc_idx")
    return rows.select("doc_idx", words(F.coalesce("text", F.lit(""))).alias("tokens"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark items, as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_idx"), words(F.coalesce("text", F.lit(""))).alias("tokens"))


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and the documents that contain their text: ``query_idx``, ``doc_idx``.

    Candidates share the item's second to fifth words; only they are searched. The items are bounded: hashes of those words
    are one row beside each document, so no run of words and no other text leaves its task."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_idx"), F.col("text").alias("_item"), words("text").alias("tokens"))
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_idx"), F.col("text").alias("_text")), "doc_idx")
    hashed = lambda tokens: F.transform(tokens, lambda t: F.xxhash64(t))
    # the first word may continue a word of the document, so runs start at the second
    keys = items.where(F.size("tokens") >= 5).select("query_idx", "_item", F.xxhash64(hashed(F.slice("tokens", 2, 4))).alias("_key"))
    runs = docs.withColumn("_h", hashed(words("_text"))).select("doc_idx", "_text", F.transform(ngrams("_h", 4), lambda g: F.xxhash64(g)).alias("_runs"))
    near = runs.crossJoin(F.broadcast(keys.agg(F.collect_set("_key").alias("_keys"))))
    near = near.select("doc_idx", "_text", F.explode(F.array_intersect("_runs", "_keys")).alias("_key"))
    long = near.join(F.broadcast(keys), "_key").where(F.contains("_text", F.col("_item"))).select("query_idx", "doc_idx")
    few = items.where(F.size("tokens") < 5).select("query_idx", "_item")
    return long.unionByName(docs.join(F.broadcast(few), F.contains("_text", F.col("_item"))).select("query_idx", "doc_idx"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user in order of time."""
    return ordered_tokens(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


def coded_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with event types as numbers by name. The types are one row, of bounded size, beside each user."""
    types = table(spark, sf_dir, "events").select("event_type").distinct().agg(F.array_sort(F.collect_list("event_type")).alias("_types"))
    coded = F.transform("tokens", lambda t: (F.array_position("_types", t) - 1).cast("int"))
    return users(spark, sf_dir).crossJoin(F.broadcast(types)).select("doc_idx", coded.alias("tokens"))


def slices(docs: DataFrame, every: int = 15, start: int = 11, length: int = 5) -> DataFrame:
    """A run of every 15th document as a query."""
    return docs.where(F.col("doc_idx") % every == 0).select(F.col("doc_idx").alias("query_idx"), F.slice("tokens", start, length).alias("tokens"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each order's lines, in line order."""
    return ordered_tokens(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber", "l_suppkey")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
