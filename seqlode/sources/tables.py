"""Token CSVs, relevance JSON, centroids, manifests, latency tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indexing import dense_index
from ..functions.keys import normalized_id, path_stem
from ..functions.tokens import parse_json_tokens, parse_tokens, stripped

#: Header names that a token table may use, compared in lower case.
NAME_HEADERS = ("filename", "file", "name", "id", "utt_id", "query_id")
TOKEN_HEADERS = ("data", "tokens", "token", "sequence")


def token_columns(columns: list[str]) -> tuple[str, str]:
    """Names of the file and token columns; the first two columns if no header is known."""
    plain = [c.strip().lower() for c in columns]
    named = [c for c, p in zip(columns, plain, strict=True) if p in NAME_HEADERS]
    tokens = [c for c, p in zip(columns, plain, strict=True) if p in TOKEN_HEADERS]
    return (named or columns)[0], (tokens or columns[1:2] or columns)[0]


def read_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """A CSV with a header, all columns strings, cells of any length, quotes doubled inside quotes.

    With ``line_breaks`` quoted cells may hold line breaks; a file is then one task. Without, large files are split."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks).option("maxCharsPerColumn", -1).csv(path)


def read_tokens(spark: SparkSession, path: str, cells: str = "plain", keep_empty: bool = False, line_breaks: bool = True) -> DataFrame:
    """A token table as ``doc_idx``, ``stem``, ``tokens``.

    ``cells``: "plain" (commas, else white space; what is no integer is skipped) or "json" (a JSON array or commas).
    White space around names does not count. Of rows with one stem the last one's tokens count, in the first one's place. Rows without tokens are left out
    unless ``keep_empty``; if nothing is left, ValueError is raised."""
    raw = read_csv(spark, path, line_breaks)
    name, data = token_columns(raw.columns)
    parse = parse_tokens if cells == "plain" else parse_json_tokens
    cell = F.coalesce(F.col(f"`{data}`"), F.lit(""))
    rows = raw.select(path_stem(stripped(F.coalesce(F.col(f"`{name}`"), F.lit("")))).alias("stem"), parse(cell).alias("tokens"), F.monotonically_increasing_id().alias("_at"))
    if not keep_empty:
        rows = rows.where(F.size("tokens") > 0)
    rows = rows.groupBy("stem").agg(F.min("_at").alias("_at"), F.max_by("tokens", "_at").alias("tokens"))
    if rows.isEmpty():
        raise ValueError(f"no token sequence in {path}")
    return dense_index(rows, ["_at"], "doc_idx").select("doc_idx", "stem", "tokens")


def read_corpus(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_tokens(spark, path, **options)


def read_queries(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_tokens(spark, path, **options).withColumnRenamed("doc_idx", "query_idx")


def read_relevance(spark: SparkSession, path: str, ids: str = "stem") -> DataFrame:
    """A relevance file: ``query_stem``, ``doc_stem``, ``key_order``. It is one JSON object, or has an object with ``query``
    and ``relevant`` on each line, as ``write_relevance`` writes (which many tasks can read).

    A value of the one object is an object with the list ``relevant``, or a list. ``ids``: "stem" takes file stems, "suffix" what
    follows their last underscore, "raw" the strings themselves. A key with an empty list has a row with a null
    document."""
    make: dict[str, callable] = {"stem": path_stem, "suffix": normalized_id, "raw": lambda c: c}
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.json_object_keys("value").alias("k")).first()
    if head and set(head["k"] or ()) == {"query", "relevant"}:
        lines = spark.read.schema("query string, relevant array<string>").json(path)
        each = lines.select(make[ids](F.col("query")).alias("query_stem"), F.monotonically_increasing_id().alias("key_order"), F.explode_outer("relevant").alias("d"))
        return each.select("query_stem", make[ids](F.col("d")).alias("doc_stem"), "key_order")
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("key_order", "e"))
    named = F.from_json("e.value", "struct<relevant:array<string>>")["relevant"]
    listed = F.when(F.col("e.value").startswith("{"), named).otherwise(F.from_json("e.value", "array<string>"))
    each = pairs.select(make[ids](F.col("e.key")).alias("query_stem"), "key_order", F.explode_outer(listed).alias("d"))
    return each.select("query_stem", make[ids](F.col("d")).alias("doc_stem"), "key_order")


def named_counts(relevance: DataFrame, distinct: bool = True) -> DataFrame:
    """Documents that the relevance names for each query, 0 for an empty list: ``query_stem``, ``n_rel``."""
    what: Column = F.countDistinct("doc_stem") if distinct else F.count("doc_stem")
    return relevance.groupBy("query_stem").agg(what.alias("n_rel"))


def read_manifest(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """A manifest as it is written, an object a line, or one JSON array; ``languages`` keeps those of the column ``lang``."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.json_object_keys("value").alias("k")).first()
    rows = spark.read.option("multiLine", not (head and head["k"])).json(path)
    return rows if languages is None else rows.where(F.col("lang").isin(languages))


def read_centroids(spark: SparkSession, path: str, expect: dict | None = None) -> DataFrame:
    """Centroids written by ``write_centroids``: ``token``, ``centroid``. ``expect`` is compared with what was noted."""
    noted = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()["value"])
    wrong = {k: (v, noted.get(k)) for k, v in (expect or {}).items() if noted.get(k) != v}
    if wrong:
        raise ValueError(f"{path} was made otherwise: {wrong}")
    return spark.read.parquet(f"{path}/centroids")


def read_latencies(spark: SparkSession, path: str) -> DataFrame:
    """Mean of each ``*_ms_mean`` column of a latency table: ``system``, ``ms``."""
    raw = read_csv(spark, path)
    found = [c for c in raw.columns if c.endswith("_ms_mean")]
    if not found:
        return spark.createDataFrame([], "system string, ms double")
    means = raw.agg(*(F.avg(F.col(f"`{c}`").try_cast("double")).alias(c) for c in found))
    return means.unpivot([], found, "system", "ms").withColumn("system", F.regexp_replace("system", "_ms_mean$", ""))


def find_configs(spark: SparkSession, folder: str, corpus: str = "corpus.csv", queries: str = "queries.csv") -> list[tuple[str, str, str]]:
    """(label, corpus path, queries path) of the folders below ``folder`` that hold both files, by label; any file
    system that Spark can open."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for s in fs.listStatus(top):
        a, b = (jvm.org.apache.hadoop.fs.Path(s.getPath(), n) for n in (corpus, queries))
        if s.isDirectory() and fs.exists(a) and fs.exists(b):
            out.append((s.getPath().getName(), a.toString(), b.toString()))
    return sorted(out)


def parse_config(spec: str) -> tuple[str, str, str]:
    """``label:corpus:queries``."""
    parts = spec.split(":")
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"expected label:corpus:queries, got {spec!r}")
    return parts[0], parts[1], parts[2]
