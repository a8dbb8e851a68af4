"""Registered queries of the corpus operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, exact_dedup, fingerprints, language_id, line_dedup, mixing, ngram_join, pii, secrets, substring_dedup
from .common import table


def tokenizer_files() -> tuple[str, str]:
    """Rank file and pre-split pattern of the registered BPE query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(mixing.mix(mixing.by_source(table(spark, sf_dir, "documents"))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(exact_dedup.exact_dedup(table(spark, sf_dir, "documents")))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(fingerprints.fingerprint_edits(table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_pii(table(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source counts as an owner, each of its languages as a repository."""
    docs = table(spark, sf_dir, "documents")
    return secrets.report(secrets.find_secrets(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang")))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.digests(bpe_codec.bpe_round_trip(docs, *tokenizer_files()))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(line_dedup.line_dedup(table(spark, sf_dir, "documents"), fine=line_dedup.FINE))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


# the columns of four operators' results that SQL can express, against SQL


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op1_mixing(spark, sf_dir)
    return rows.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


#: Sources share all words by weight; of those in the order in which they would reach three times their size, the first
#: j have reached it, where the level of the rest is not above that of the next one.
MIX_TARGETS = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST) AS j FROM s),
c AS (SELECT j, 3 * source_size / CAST(weight AS DOUBLE) AS own, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM o),
l AS (SELECT arg_min(level, j) AS level FROM c WHERE level <= own)
SELECT doc_id, size, source_size, round(least(3.0 * source_size, weight * level), 4) AS target, true AS within FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source CROSS JOIN l"""

FINGERPRINT_EDITS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS other FROM d)
SELECT doc_id, n AS n_chars, sha256(substring(t, 1, n - n // 2) || substring(other, 1, n // 2)) AS edited_sha256 FROM n"""

_LUHN = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN (len({0}) - i) % 2 = 0 THEN CAST({0}[i] AS INT) WHEN CAST({0}[i] AS INT) > 4 THEN 2 * CAST({0}[i] AS INT) - 9 ELSE 2 * CAST({0}[i] AS INT) END)) % 10 = 0"

PII_COUNTS = (
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards,
  list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phones FROM d)
SELECT doc_id, n_email::BIGINT AS n_email,
  len(list_filter(ips, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS DOUBLE))) <= 255))::BIGINT AS n_ip,
  len(list_filter(list_filter(cards, lambda x: len(x) BETWEEN 13 AND 19), lambda x: """
    + _LUHN.format("x")
    + """))::BIGINT AS n_card,
  len(list_filter(phones, lambda x: len(x) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM m"""
)

SECRET_COUNTS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: len(x) >= 24))::BIGINT AS n_hex FROM d"""

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_pii": op5_pii,
    "op6_secrets": op6_secrets,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_substring_dedup": op10_substring_dedup,
}

#: Columns of four operators' results that have SQL, by name.
COLUMN_QUERIES = {
    "mix_targets": mix_targets,
    "fingerprint_edits": fingerprint_edits,
    "pii_base_counts": pii_base_counts,
    "secret_base_counts": secret_base_counts,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "mix_targets": MIX_TARGETS,
    "fingerprint_edits": FINGERPRINT_EDITS,
    "pii_base_counts": PII_COUNTS,
    "secret_base_counts": SECRET_COUNTS,
}
