"""Scores and rankings of all pairs in tiles, held against the functions of single pairs."""

import random

import pytest
from pyspark.sql import functions as F

from seqlode.operators import align, grid, rank, similarity
from seqlode.plans.catalog import QUERIES
from seqlode.plans.systems import System, ranking, similarities

from .conftest import SMALL

JOINS = ("CartesianProduct", "NestedLoopJoin")


def sides(spark):
    """Sequences of many lengths, equal and empty ones among them, and queries that begin alike."""
    draw = random.Random(3)
    docs = [(i, [draw.choice("abcd") for _ in range(draw.choice([0, 1, 2, 9, 60]))]) for i in range(90)]
    docs += [(90 + i, docs[i][1]) for i in range(20)]
    queries = [(i, [draw.choice("abe") for _ in range(i % 5)] + ["c"] * (i % 13 == 12) * 9) for i in range(60)]
    schema = "long, tokens array<string>"
    return spark.createDataFrame(queries, f"query_idx {schema}"), spark.createDataFrame(docs, f"doc_idx {schema}")


def pairs(queries, docs):
    return docs.crossJoin(queries.select("query_idx", F.col("tokens").alias("q")))


def same(found, want):
    assert found.count() == want.count()
    assert found.exceptAll(want).count() == 0


def test_warping_of_all_pairs(spark):
    queries, docs = sides(spark)
    same(grid.warping_distances(queries, docs, digits=6), pairs(queries, docs).select("query_idx", "doc_idx", F.round(align.warping_distance(F.col("q"), F.col("tokens")), 6)))


@pytest.mark.parametrize("costs", [(2.0, -1.0, -2.0), (1.5, -0.25, -0.5)])
def test_alignment_of_all_pairs(spark, costs):
    queries, docs = sides(spark)
    q, d = F.col("q"), F.col("tokens")
    of = lambda per: align.alignment_score(q, d, *costs, per=per)
    found = grid.alignment_scores(queries, docs, *costs, digits=6, score="query", best="best", raw="raw")
    same(found, pairs(queries, docs).select("query_idx", "doc_idx", F.round(of("query"), 6), F.round(of("best"), 6), of("raw")))


def test_tiles_are_cut(spark, monkeypatch):
    import numpy as np

    docs = [np.arange(n % 7) for n in range(50)]
    own = grid.Sequences(np.arange(50), np.array([len(x) for x in docs]), np.concatenate(docs))
    whole = {(n, i): x for n, at, raw in grid.tiles([np.array([1, 2])], own, grid.Warping()) for i, x in zip(at, raw)}
    monkeypatch.setattr(grid, "CELLS", 10)
    parts = {(n, i): x for n, at, raw in grid.tiles([np.array([1, 2])], own, grid.Warping()) for i, x in zip(at, raw)}
    assert whole == parts and len(whole) == sum(len(x) > 0 for x in docs)


def test_rounding_is_that_of_spark(spark):
    draw = random.Random(5)
    values = [draw.random() for _ in range(500)] + [draw.randrange(10**7) / 10**7 for _ in range(500)] + [i / 64 for i in range(-64, 640)] + [0.1234565, 2.5e-7, 1.0000005]
    want = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6).alias("x")).collect()]
    import numpy as np

    assert [x / 1e6 for x in grid.rounded(np.array(values), 6)] == want


@pytest.mark.parametrize("name", ["dtw_scores", "sw_scores", "sw_scores_normalised"])
def test_no_row_carries_both_sequences(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [j for j in JOINS if j in plan]


@pytest.mark.parametrize("name", ["dtw_rank"])
def test_rankings_are_made_without_a_window_over_pairs(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [j for j in (*JOINS, "Window") if j in plan]


def test_ranks_by_warping(spark, monkeypatch):
    queries, docs = sides(spark)
    distance = F.round(align.warping_distance(F.col("q"), F.col("tokens")), 9).alias("distance")
    want = similarity.ranked(pairs(queries, docs).select("query_idx", "doc_idx", distance), "rank", F.asc("distance"), F.asc("doc_idx"))
    same(rank.by_warping(queries, docs).select(*want.columns), want)


@pytest.mark.parametrize("tau, few", [(None, 7), (0.0, 7), (0.0, 500), (None, None)])
def test_full_rankings_agree_with_those_from_similarities(spark, tau, few):
    queries, docs = sides(spark)
    system = System("x", tau=tau, candidates=few)
    want = ranking(docs, queries, system, similarities(docs, queries, system))
    # similarities of 0 or less are not told apart there when candidates are filled up
    same(ranking(docs, queries, system).select("query_idx", "doc_idx", "rank"), want.select("query_idx", "doc_idx", "rank"))
    got = ranking(docs, queries, system).where("rank = 1").orderBy("query_idx").collect()
    assert [(r.query_idx, r.sim) for r in got] == [(r.query_idx, r.sim) for r in want.where("rank = 1").orderBy("query_idx").collect()]


@pytest.mark.parametrize("name", ["aligned_full_rank", "paired_full_rank"])
def test_full_rankings_join_no_pairs(spark, monkeypatch, name):
    monkeypatch.delattr(rank, "all_pairs")
    QUERIES[name](spark, SMALL)
