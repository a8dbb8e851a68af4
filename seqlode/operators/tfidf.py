"""TF-IDF weights in long form: ``doc_idx``, ``gram``, ``w``. A document without a weighted n-gram has no row."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pmi as pmi_op
from . import stats


def normalized(weights: DataFrame, id_col: str = "doc_idx") -> DataFrame:
    """L2-normalised by document; weights of norm zero stay zero."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return weights.withColumn("_norm", norm).select(id_col, "gram", (F.col("w") / F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm"))).alias("w"))


def part(docs: DataFrame, n: int, idf: DataFrame, id_col: str = "doc_idx", scale: float = 1.0) -> DataFrame:
    """Weights of the n-grams of one order: share of the document's n-grams, those outside ``idf`` included in the
    denominator, times idf and ``scale``."""
    tf: Column = F.col("cnt") / (F.col("length") - (n - 1))
    return stats.term_counts(docs, n, id_col).join(idf.select("gram", "idf"), "gram").select(id_col, "gram", (tf * F.col("idf") * scale).alias("w"))


@dataclass
class UnigramModel:
    """IDF of single tokens; ``weights`` applies it to any sequences."""

    idf: DataFrame

    @classmethod
    def fit(cls, docs: DataFrame) -> UnigramModel:
        return cls(stats.idf_table(docs))

    def weights(self, docs: DataFrame, id_col: str = "doc_idx") -> DataFrame:
        return normalized(part(docs, 1, self.idf, id_col), id_col)


@dataclass
class PairModel:
    """Single tokens and the pairs whose PMI exceeds ``tau``, the pairs times ``alpha``, normalised together.

    ``alpha`` of zero or less leaves the pairs out. Document frequencies are counted of the selected pairs alone."""

    idf: DataFrame
    pair_idf: DataFrame
    alpha: float = 1.0

    @classmethod
    def fit(cls, docs: DataFrame, tau: float = 0.5, alpha: float = 1.0, min_count: int = 2, scores: DataFrame | None = None) -> PairModel:
        scores = pmi_op.pmi(docs, min_count) if scores is None else scores
        return cls(stats.idf_table(docs, counted=stats.gram_table(docs)), stats.idf_table(docs, 2, counted=pmi_op.selected_pairs(scores, tau)), alpha)

    def weights(self, docs: DataFrame, id_col: str = "doc_idx") -> DataFrame:
        parts = part(docs, 1, self.idf, id_col)
        if self.alpha > 0:
            parts = parts.unionByName(part(docs, 2, self.pair_idf, id_col, self.alpha))
        return normalized(parts, id_col)


@dataclass
class MixedModel:
    """N-grams of several orders, each times 1/sqrt(n), with ln(N/df); not normalised, zero IDF left out."""

    idf: dict[int, DataFrame]

    @classmethod
    def fit(cls, docs: DataFrame, orders: tuple[int, ...] = (1, 2, 3)) -> MixedModel:
        return cls({n: stats.idf_table(docs, n, stats.plain_idf) for n in orders})

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.idf.values())

    def weights(self, docs: DataFrame, id_col: str = "doc_idx") -> DataFrame:
        return reduce(DataFrame.unionByName, (part(docs, n, idf.where("idf != 0"), id_col, 1 / math.sqrt(n)) for n, idf in self.idf.items()))
