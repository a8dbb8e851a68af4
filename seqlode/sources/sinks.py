"""Writers: metric rows, token tables, corpus preparations, centroids."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import token_string

#: Fields of the result tables.
RUN_FIELDS = ["system", "tau", "alpha", "candidates", "map", "mrr", "p_at_1", "p_at_5", "p_at_10", "time_s", "corpus", "queries"]


def append_rows(rows: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Append to a CSV folder; every part has the header."""
    (rows if fields is None else rows.select(*fields)).write.mode("append").option("header", True).csv(path)


def write_rows(tables: list[DataFrame], path: str, fields: list[str] | None = None) -> None:
    """Replace a CSV folder by the union of tables; columns that a table lacks are null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    (rows if fields is None else rows.select(*fields)).write.mode("overwrite").option("header", True).csv(path)


def write_tokens(docs: DataFrame, path: str) -> None:
    """A token table with the columns Filename and Data (comma-separated)."""
    docs.select(F.col("stem").alias("Filename"), token_string("tokens").alias("Data")).write.mode("overwrite").option("header", True).csv(path)


def write_file_list(rows: DataFrame, path: str) -> None:
    rows.select("stem", "path").write.mode("overwrite").option("header", True).csv(path)


def write_relevance(pairs: DataFrame, path: str) -> None:
    """One JSON object per line, a line per query: {"query": ..., "relevant": [...]}; ``read_relevance`` reads it. A query
    with null documents alone has an empty list."""
    pairs.groupBy(F.col("query_stem").alias("query")).agg(F.array_sort(F.collect_list("doc_stem")).alias("relevant")).write.mode("overwrite").json(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """[query, document] per line."""
    pairs.select(F.to_json(F.array("query_stem", "doc_stem")).alias("value")).write.mode("overwrite").text(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_centroids(centroids: DataFrame, path: str, **about) -> None:
    """``token``, ``centroid`` as Parquet, and what they were made with."""
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    centroids.sparkSession.range(1).select(F.lit(json.dumps(about)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/about")
