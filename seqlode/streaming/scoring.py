"""Streams of query sequences, and counts over streams of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rank, similarity
from ..plans.systems import System, model


class Scorer:
    """A fitted system: the corpus's weights are computed once and kept, each batch of queries is joined to them."""

    def __init__(self, docs: DataFrame, system: System):
        if system.candidates is None:
            raise ValueError("a streamed system needs a number of candidates")
        self.docs, self.system = docs, system
        self.model = model(docs, system)
        self.weights = self.model.weights(docs).persist()

    def rank(self, queries: DataFrame) -> DataFrame:
        """Candidates of ``queries`` (``query_idx``, ``tokens``), re-ranked: ``query_idx``, ``doc_idx``, ``sim``,
        ``sw``, ``rank``."""
        sims = similarity.sparse_cosine(self.model.weights(queries, "query_idx"), self.weights)
        front = similarity.top_candidates(sims, queries, self.docs, self.system.candidates)
        a = self.system.alignment
        return rank.reranked(front, queries, self.docs, a.match, a.mismatch, a.gap).drop("cand_rank")


def rank_stream(queries: DataFrame, scorer: Scorer, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Rank every micro-batch of a stream of queries and hand it to ``write`` with its number. A batch is repeated
    with its number after a failure, so a writer that replaces by number stores each ranking once."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            write(scorer.rank(rows), number)
        finally:
            rows.unpersist()

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def windowed_counts(tokens: DataFrame, time_col: str, token_col: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Token counts of event-time windows; rows later than ``late`` are dropped: ``start``, ``end``, ``token``, ``cnt``."""
    tokens = tokens.withColumn(time_col, F.col(time_col).cast("timestamp"))
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    rows = tokens.withWatermark(time_col, late).groupBy(span.alias("w"), F.col(token_col).alias("token")).agg(F.count(F.lit(1)).alias("cnt"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "token", "cnt")
