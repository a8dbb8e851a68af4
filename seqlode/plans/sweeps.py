"""Parameter sweeps: grids of systems over one corpus, and comparisons over several."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import relative_gain
from ..operators import bpe, pmi, stats
from .systems import ALIGNED, PAIRED, UNIGRAM, System, evaluated

#: Points of the sweeps.
TAUS = (0.0, 0.5, 1.0, 1.5, 2.0)
ALPHAS = (0.25, 0.5, 0.75, 1.0, 2.0, 5.0, 10.0)
CANDIDATES = (10, 20, 50, 100, 200)


def groups(base: System = PAIRED) -> dict[str, list[System]]:
    """Systems of each ablation group: pairs on and off, threshold, weight, candidates, alignment on and off."""
    named = lambda s, tag: replace(s, name=tag)
    return {
        "A": [named(replace(base, tau=None), "A_no_pairs"), named(base, "A_pairs")],
        "B": [named(replace(base, tau=t), f"B_tau_{t}") for t in TAUS],
        "C": [named(replace(base, alpha=a), f"C_alpha_{a}") for a in ALPHAS],
        "D": [named(replace(base, candidates=c), f"D_candidates_{c}") for c in CANDIDATES],
        "E": [named(replace(base, candidates=None), "E_cosine"), named(base, "E_aligned")],
    }


def ablation(docs: DataFrame, queries: DataFrame, truth: DataFrame, grid: dict[str, list[System]] | None = None, **mode) -> DataFrame:
    """A row per point: ``group`` and the columns of ``evaluated``. The association scores are counted once."""
    grid = groups() if grid is None else grid
    scores = {c: pmi.pmi(docs, c).persist() for c in {s.min_count for own in grid.values() for s in own}}
    rows = [evaluated(docs, queries, truth, s, scores[s.min_count], **mode).withColumn("group", F.lit(g)) for g, own in grid.items() for s in own]
    return reduce(DataFrame.unionByName, rows)


def merge_ablation(docs: DataFrame, queries: DataFrame, truth: DataFrame, sizes: list[int], system: System = PAIRED, with_queries: bool = False) -> DataFrame:
    """The system over corpora merged to vocabulary sizes; sizes that the tokens fill already are left out.

    Columns of ``evaluated`` and ``vocab_size``, ``merges``. ``with_queries`` learns from corpus and queries."""
    base = docs.select(F.max(F.array_max("tokens")).alias("m")).first()["m"]
    learn = docs.select("doc_idx", "tokens")
    if with_queries:
        learn = learn.unionByName(queries.select((-F.col("query_idx") - 1).alias("doc_idx"), "tokens"))
    rows = []
    for size in sizes:
        if base is None or size <= base + 1:
            continue
        merges = bpe.fit_to_vocabulary(learn, size)
        row = evaluated(merges.encode(docs), merges.encode(queries), truth, system)
        rows.append(row.withColumns({"vocab_size": F.lit(size), "merges": F.lit(len(merges.steps))}))
    if not rows:
        raise ValueError("no vocabulary size exceeds that of the tokens")
    return reduce(DataFrame.unionByName, rows)


def over_configs(configs: list[tuple[str, DataFrame, DataFrame, DataFrame]], systems: tuple[System, ...] = (UNIGRAM, ALIGNED, PAIRED), **mode) -> DataFrame:
    """A row per (label, corpus, queries, truth) and system, with ``vocab_size`` and ``rho``; tokenisers, layers and
    languages are labels."""
    rows = []
    for label, docs, queries, truth in configs:
        about = stats.sequence_stats(docs).select("vocab_size").crossJoin(F.broadcast(stats.length_ratio(queries, docs)))
        for s in systems:
            rows.append(evaluated(docs, queries, truth, s, **mode).crossJoin(F.broadcast(about)).withColumn("label", F.lit(label)))
    return reduce(DataFrame.unionByName, rows)


def side_by_side(rows: DataFrame, systems: tuple[str, ...], base: str, best: str) -> DataFrame:
    """One row per label: each system's metrics under its name, and the gain of ``best`` over ``base``."""
    values = [c for c in ("map", "mrr", "p_at_1", "p_at_5", "p_at_10") if c in rows.columns]
    wide = rows.groupBy("label").agg(*(F.max(F.when(F.col("system") == s, F.col(v))).alias(f"{s}_{v}") for s in systems for v in values))
    return wide.withColumns({f"{v}_gain": relative_gain(f"{best}_{v}", f"{base}_{v}") for v in values})


def averages(rows: DataFrame) -> DataFrame:
    """Means over labels, by system."""
    values = [c for c in ("map", "mrr", "p_at_1", "p_at_5", "p_at_10") if c in rows.columns]
    return rows.groupBy("system").agg(*(F.avg(v).alias(v) for v in values))


def best_by(rows: DataFrame, by: str, what: str, value: str = "map") -> DataFrame:
    """For each ``by`` the ``what`` of the largest ``value``, of equal ones the least: ``by``, ``what``, ``value``."""
    first = F.min(F.struct((-F.col(value)).alias("v"), F.col(what).alias("w"))).alias("x")
    return rows.groupBy(by).agg(first).select(by, F.col("x.w").alias(what), (-F.col("x.v")).alias(value))
