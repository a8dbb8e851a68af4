"""Cosines for several systems at once, held against those of each system."""

import pytest
from pyspark.sql import functions as F

from seqlode.operators import corpus_cosine, rank, tfidf
from seqlode.plans import corpora
from seqlode.plans.catalog import QUERIES
from seqlode.plans.systems import System, similarities

from .conftest import SMALL
from .test_grid import sides


@pytest.mark.parametrize("slice_of", [10**6, 7])
def test_cosines_of_several_systems(spark, monkeypatch, slice_of):
    monkeypatch.setattr(corpus_cosine, "SLICE", slice_of)
    monkeypatch.setattr(corpus_cosine, "ROWS", 11)
    queries, docs = sides(spark)
    points = [(None, 1.0), (-0.1, 0.5), (0.0, 1.0), (0.0, 0.0)]
    found = corpus_cosine.cosines(docs, queries, points)
    for s, (tau, alpha) in enumerate(points):
        want = {(r.query_idx, r.doc_idx): r.sim for r in similarities(docs, queries, System("x", tau, alpha)).where("sim != 0").collect()}
        got = {(r.query_idx, r.doc_idx): r.sim for r in found.select("query_idx", "doc_idx", F.col(f"sim_{s}").alias("sim")).where("sim != 0").collect()}
        assert got == pytest.approx(want, abs=2e-9)


@pytest.mark.parametrize("name", ["alpha_tau_sweep", "gain_vs_baseline", "paired_rerank_documents"])
def test_documents_are_not_weighed_row_by_row(spark, monkeypatch, name):
    monkeypatch.delattr(tfidf, "part")
    QUERIES[name](spark, SMALL)


@pytest.mark.parametrize("slice_of", [10**6, 7])
def test_ranks_of_a_few_documents(spark, monkeypatch, slice_of):
    monkeypatch.setattr(corpus_cosine, "SLICE", slice_of)
    monkeypatch.setattr(corpus_cosine, "ROWS", 11)
    queries, docs = sides(spark)
    # negative cosines, ties and documents that share nothing are among them
    pairs = docs.crossJoin(queries).where((F.col("doc_idx") * 7 + F.col("query_idx")) % 4 == 0).select("query_idx", "doc_idx")
    points = [(None, 1.0), (-0.1, 0.5), (0.0, 1.0)]
    found = corpus_cosine.ranks(docs, queries, pairs, points)
    for s, (tau, alpha) in enumerate(points):
        want = rank.ranks_of(pairs, similarities(docs, queries, System("x", tau, alpha)), docs)
        got = found.select("query_idx", "doc_idx", F.col(f"rank_{s}").alias("rank"))
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("name", ["alpha_tau_sweep", "gain_vs_baseline"])
def test_sweeps_have_no_rows_of_pairs(spark, monkeypatch, name):
    monkeypatch.delattr(corpus_cosine, "cosines")
    monkeypatch.delattr(rank, "ranks_of")
    QUERIES[name](spark, SMALL)


def test_contained_exchanges_neither_texts_nor_runs(spark, monkeypatch):
    monkeypatch.setattr(corpora, "spread", lambda df, key: df)
    plan = corpora.contained(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
