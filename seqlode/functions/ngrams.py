"""N-grams of token arrays, as arrays, within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(tokens: str | Column, n: int) -> Column:
    """All runs of ``n`` tokens, in order, overlapping; empty if the sequence is shorter."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    if n == 1:
        return F.transform(t, lambda x: F.array(x))
    last = F.size(t) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(t, i, n))).otherwise(F.slice(F.array(t), 1, 0))


def bigrams(tokens: str | Column) -> Column:
    return ngrams(tokens, 2)
