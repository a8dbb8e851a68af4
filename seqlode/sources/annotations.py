"""Annotation files of spoken-term benchmarks, and listings of audio files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import path_stem


def _xml_attribute(spark: SparkSession, path: str, xpath: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.xpath("value", F.lit(xpath))).alias("pos", "x"))


def read_excerpts(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an excerpt list in file order: ``pos``, ``stem``."""
    return _xml_attribute(spark, path, "/*/excerpt/@audio_filename").select("pos", path_stem("x").alias("stem"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a term list in file order: ``pos``, ``stem``."""
    return _xml_attribute(spark, path, "/*/term/@termid").select("pos", F.col("x").alias("stem"))


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """LEXEME rows of an RTTM file with six columns or more: ``term``, ``doc``, in no order."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 6) & (F.col("f")[0] == "LEXEME"))
    return rows.select(F.col("f")[5].alias("term"), path_stem(F.col("f")[1]).alias("doc"))


def occurrences_by_term(rows: DataFrame) -> DataFrame:
    """``term``, ``docs`` (with repetitions), ``n``."""
    return rows.groupBy("term").agg(F.array_sort(F.collect_list("doc")).alias("docs"), F.count(F.lit(1)).alias("n"))


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """``stem``, ``path`` of the .wav and .flac files of a folder; the files are listed, not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,flac}").load(folder)
    return files.select(path_stem("path").alias("stem"), "path").orderBy("path")
