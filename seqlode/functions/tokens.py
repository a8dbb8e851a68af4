"""Token arrays from strings and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stripped(c: str | Column) -> Column:
    """Without white space at either end, line breaks included."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")


def parse_tokens(c: str | Column) -> Column:
    """Integers of a cell that is separated by commas if it has one, else by white space.

    Parts that are no integers are skipped, among them the bracketed ends of a JSON-style list."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.when(F.contains(c, F.lit(",")), F.split(c, ",")).otherwise(F.split(stripped(c), r"\s+"))
    whole = F.filter(F.transform(parts, stripped), lambda t: t.rlike("^-*[0-9]+$"))
    return F.filter(F.transform(whole, lambda t: t.try_cast("int")), lambda t: t.isNotNull())


def parse_json_tokens(c: str | Column) -> Column:
    """Integers of a cell that holds a JSON array or comma-separated numbers; spaces do not separate. Null if a part
    is no number."""
    c = stripped(c)
    parts = F.filter(F.transform(F.split(c, ","), stripped), lambda t: t != "")
    return F.when(c.startswith("["), F.from_json(c, "array<int>")).otherwise(F.transform(parts, lambda t: t.try_cast("int")))


def words(c: str | Column) -> Column:
    """Runs of ASCII letters, in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))


def ordered_tokens(df: DataFrame, doc: str, token: str, *order: str) -> DataFrame:
    """A sequence per document from one row per token: ``doc_idx``, ``tokens``."""
    struct = F.struct(*order, F.col(token).alias("_token"))
    return df.groupBy(F.col(doc).alias("doc_idx")).agg(F.transform(F.array_sort(F.collect_list(struct)), lambda x: x["_token"]).alias("tokens"))


def token_string(c: str | Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(c, lambda t: t.cast("string")), sep)
