"""Command line: run retrieval systems over token files.

    python -m seqlode --system all --corpus corpus.csv --queries queries.csv --relevance relevance.json
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import groundtruth, stats
from ..sources import sinks, tables
from .systems import ALIGNED, PAIRED, UNIGRAM, Alignment, System, timed

SYSTEMS = {s.name: s for s in (UNIGRAM, ALIGNED, PAIRED)}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="seqlode", description="Query-by-example retrieval over token sequences.")
    p.add_argument("--system", choices=[*SYSTEMS, "all"], default=PAIRED.name)
    for name in ("corpus", "queries", "relevance"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--tau", type=float, default=PAIRED.tau)
    p.add_argument("--alpha", type=float, default=PAIRED.alpha)
    p.add_argument("--candidates", type=int, default=PAIRED.candidates)
    p.add_argument("--min-count", type=int, default=PAIRED.min_count)
    p.add_argument("--match", type=float, default=Alignment.match)
    p.add_argument("--mismatch", type=float, default=Alignment.mismatch)
    p.add_argument("--gap", type=float, default=Alignment.gap)
    p.add_argument("--output", help="CSV folder to which the rows are appended")
    return p.parse_args(argv)


def configured(args: argparse.Namespace) -> list[System]:
    chosen = SYSTEMS.values() if args.system == "all" else [SYSTEMS[args.system]]
    a = Alignment(args.match, args.mismatch, args.gap)
    return [
        replace(
            s,
            tau=None if s.tau is None else args.tau,
            alpha=args.alpha,
            candidates=None if s.candidates is None else args.candidates,
            min_count=args.min_count,
            alignment=a,
        )
        for s in chosen
    ]


def run(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    docs, queries = tables.read_corpus(spark, args.corpus).persist(), tables.read_queries(spark, args.queries).persist()
    relevance = tables.read_relevance(spark, args.relevance)
    truth = groundtruth.ground_truth(queries, docs, relevance).persist()
    stats.sequence_stats(docs).show()
    groundtruth.coverage(queries, truth).show()
    rows = [timed(docs, queries, truth, s) | {"corpus": args.corpus, "queries": args.queries} for s in configured(args)]
    schema = "system string, tau double, alpha double, candidates int, map double, mrr double, p_at_1 double, p_at_5 double, p_at_10 double, time_s double, corpus string, queries string"
    table = spark.createDataFrame([tuple(r[f] for f in sinks.RUN_FIELDS) for r in rows], schema)
    table.select("system", *(F.round(c, 4).alias(c) for c in ("map", "mrr", "p_at_1", "p_at_5", "p_at_10", "time_s"))).show(truncate=False)
    if args.output:
        sinks.append_rows(table, args.output, sinks.RUN_FIELDS)
    return rows


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    run(SparkSession.builder.appName("seqlode").getOrCreate(), args)
