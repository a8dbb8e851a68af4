"""Exact deduplication by skew-safe combining.

Equal contents meet three times: within a task (Spark's partial aggregation), within a salted digest group, and
among the winners of the salts. Each time the grouping key holds the whole content beside its digest, so two
contents with one digest never merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that one content's rows are dealt to.
SALTS = 64


def fold_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def sha256_digest(col: Column) -> Column:
    return F.unhex(F.sha2(col, 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalize: Callable[[Column], Column] = fold_ascii,
    digest: Callable[[Column], Column] = sha256_digest,
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: ``id_col``, ``digest``, ``keep_id``, ``group_size``, ``kept``.

    A null text counts as empty. Of equal contents the row with the largest id stays; if several rows have that id,
    exactly one of them is marked as kept. A null id counts as smaller than any other."""
    content = normalize(text_or_empty(text_col))
    keyed = docs.select(F.col(id_col).alias("_id"), content.alias("_content")).select(
        "_id", "_content", digest(F.col("_content")).alias("_digest"), F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt")
    )
    salted = keyed.groupBy("_digest", "_salt", "_content").agg(F.max("_id").alias("_win"), F.count(F.lit(1)).alias("_n"))
    # at most `salts` numbers are gathered for a content
    whole = salted.groupBy("_digest", "_content").agg(F.max("_win").alias("_keep"), F.sum("_n").alias("_size"), F.collect_set("_salt").alias("_salts"))
    parts = materialize(whole.select("_digest", F.explode("_salts").alias("_salt"), F.col("_keep"), F.col("_size")), "exact")
    on = ["_digest", "_salt"]
    if parts.groupBy(*on).count().where("count > 1").limit(1).count():
        # two contents share a digest: attach by the content itself
        parts, on = whole.withColumn("_salt", F.explode("_salts")).drop("_salts"), [*on, "_content"]
        rows = keyed
    else:
        rows = keyed.drop("_content")
    first = F.row_number().over(Window.partitionBy(*on, "_id").orderBy(F.lit(0)))
    return rows.join(parts, on).select(
        F.col("_id").alias(id_col),
        F.col("_digest").alias("digest"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (first == 1)).alias("kept"),
    )


def report(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The registered query's columns from the operator's."""
    return result.select(id_col, "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS content FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM d WINDOW w AS (PARTITION BY content)
"""
