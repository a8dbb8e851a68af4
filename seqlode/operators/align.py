"""Local alignment and time warping of token sequences: Arrow UDFs over padded batches.

Both recurrences run row by row over the query; within a row the dependency on the left neighbour is a running
maximum (alignment) or minimum (warping), so a whole batch advances one query token at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells (pairs x document length) of a padded batch.
CELLS = 1 << 20


def _padded(seqs: list, width: int, fill: int) -> np.ndarray:
    out = np.full((len(seqs), width), fill, dtype=np.int64)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out


def _batches(q: list, d: list) -> Iterator[np.ndarray]:
    """Positions of pairs of similar length, up to CELLS a batch."""
    order = np.lexsort(([len(x) for x in q], [len(x) for x in d]))
    start = 0
    for end in range(1, len(order) + 1):
        if end == len(order) or (end + 1 - start) * max(1, len(d[order[end]])) > CELLS:
            yield order[start:end]
            start = end


def _codes(q: list, d: list) -> tuple[list, list]:
    """The sequences as small numbers, equal for equal tokens."""
    if not q:
        return [], []
    flat = np.concatenate([np.asarray(x) for x in (*q, *d)])
    _, codes = np.unique(flat, return_inverse=True)
    parts = np.split(codes, np.cumsum([len(x) for x in (*q, *d)])[:-1])
    return parts[: len(q)], parts[len(q) :]


def local_scores(q: list, d: list, match: float, mismatch: float, gap: float) -> np.ndarray:
    """Largest cell of each pair's local alignment, 0 if a side is empty. ``gap`` is negative."""
    out = np.zeros(len(q))
    full = [i for i in range(len(q)) if len(q[i]) and len(d[i])]
    cq, cd = _codes([q[i] for i in full], [d[i] for i in full])
    for at in _batches(cq, cd):
        m, n = max(len(cq[i]) for i in at), max(len(cd[i]) for i in at)
        x, y = _padded([cq[i] for i in at], m, -1), _padded([cd[i] for i in at], n, -2)
        slope = gap * np.arange(n + 1)
        h, best = np.zeros((len(at), n + 1)), np.zeros(len(at))
        for i in range(m):
            step = np.where(x[:, i, None] == y, match, mismatch)
            t = np.zeros_like(h)
            np.maximum(h[:, :-1] + step, h[:, 1:] + gap, out=t[:, 1:])
            np.maximum(t, 0, out=t)
            h = np.maximum.accumulate(t - slope, axis=1) + slope
            np.maximum(best, h.max(axis=1), out=best)
        out[np.asarray(full)[at]] = best
    return out


def warp_costs(q: list, d: list) -> np.ndarray:
    """Unconstrained time warping with cost 0 for equal and 1 for different tokens; NaN if a side is empty."""
    out = np.full(len(q), np.nan)
    full = [i for i in range(len(q)) if len(q[i]) and len(d[i])]
    cq, cd = _codes([q[i] for i in full], [d[i] for i in full])
    for at in _batches(cq, cd):
        lq, ld = np.array([len(cq[i]) for i in at]), np.array([len(cd[i]) for i in at])
        x, y = _padded([cq[i] for i in at], lq.max(), -1), _padded([cd[i] for i in at], ld.max(), -2)
        before = np.full((len(at), y.shape[1] + 1), np.inf)
        before[:, 0] = 0
        found = np.zeros(len(at))
        for i in range(x.shape[1]):
            cost = np.cumsum(x[:, i, None] != y, axis=1, dtype=float)
            over = np.minimum(before[:, 1:], before[:, :-1])
            row = cost + np.minimum.accumulate(over - np.c_[np.zeros(len(at)), cost[:, :-1]], axis=1)
            done = lq == i + 1
            found[done] = row[done, ld[done] - 1]
            before = np.c_[np.full(len(at), np.inf), row]
        out[np.asarray(full)[at]] = found
    return out


def _numbers(tokens: Column) -> Column:
    """Tokens as 64-bit hashes, so that workers get numbers whatever the tokens are."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def alignment_score(query: Column, doc: Column, match: float = 2.0, mismatch: float = -1.0, gap: float = -2.0, per: str = "query") -> Column:
    """Smith-Waterman score of two token arrays. ``per``: "query" divides by the query's length (range 0 to
    ``match``), "best" by ``match`` times that (0 to 1), "raw" does not divide."""

    @F.pandas_udf("double")
    def score(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(local_scores(list(q), list(d), match, mismatch, gap))

    raw = score(_numbers(query), _numbers(doc))
    if per == "raw":
        return raw
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(raw / (F.size(query) * (match if per == "best" else 1.0)))


def warping_distance(query: Column, doc: Column) -> Column:
    """Time-warping cost over the sum of the lengths; 1 if a side is empty."""

    @F.pandas_udf("double")
    def cost(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(warp_costs(list(q), list(d)))

    return F.when((F.size(query) == 0) | (F.size(doc) == 0), F.lit(1.0)).otherwise(cost(_numbers(query), _numbers(doc)) / (F.size(query) + F.size(doc)))


def aligned(candidates: DataFrame, queries: DataFrame, docs: DataFrame, match: float = 2.0, mismatch: float = -1.0, gap: float = -2.0) -> DataFrame:
    """``candidates`` with ``sw``, the alignment score of their sequences."""
    rows = candidates.join(docs.select("doc_idx", F.col("tokens").alias("_d")), "doc_idx").join(queries.select("query_idx", F.col("tokens").alias("_q")), "query_idx")
    return rows.withColumn("sw", alignment_score(F.col("_q"), F.col("_d"), match, mismatch, gap)).drop("_q", "_d")
