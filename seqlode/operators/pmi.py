"""Pointwise mutual information of adjacent tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats


def pmi(docs: DataFrame, min_count: int = 2) -> DataFrame:
    """``a``, ``b``, ``cnt``, ``df``, ``pmi`` of the pairs seen ``min_count`` times or more, ``df`` in so many documents.

    Natural logarithm of p(a, b) / (p(a) p(b)); pairs do not cross documents, and rare ones count in the totals. The
    filter stands before the joins, so only frequent pairs meet the token counts."""
    pairs = stats.gram_table(docs, 2).where(F.col("cnt") >= min_count).select(F.col("gram")[0].alias("a"), F.col("gram")[1].alias("b"), "cnt", "df")
    single = stats.gram_table(docs, 1).select(F.col("gram")[0].alias("t"), F.col("cnt").alias("c"))
    first, second = single.select(F.col("t").alias("a"), F.col("c").alias("ca")), single.select(F.col("t").alias("b"), F.col("c").alias("cb"))
    sized = pairs.join(first, "a").join(second, "b").crossJoin(F.broadcast(stats.corpus_size(docs).select("n_tok", "n_bi")))
    ratio = (F.col("cnt") / F.col("n_bi")) / ((F.col("ca") / F.col("n_tok")) * (F.col("cb") / F.col("n_tok")))
    return sized.select("a", "b", "cnt", "df", F.ln(ratio).alias("pmi"))


def selected_pairs(scores: DataFrame, tau: float = 0.5) -> DataFrame:
    """Pairs whose PMI exceeds ``tau``, as ``gram``, ``cnt``, ``df``, ``pmi``."""
    return scores.where(F.col("pmi") > tau).select(F.array("a", "b").alias("gram"), "cnt", "df", "pmi")
