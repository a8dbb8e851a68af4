"""Every registered query with SQL, held against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqlode.plans.catalog import ORACLES, QUERIES

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] + 0.0 if isinstance(r[i], float) else r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_optional_part_may_be_missing(monkeypatch):
    import builtins

    real = builtins.__import__

    def gone(name, *a, **k):
        if name == "corpus_pipeline" or name.startswith("seqlode.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", gone)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLES)


def test_flagship_aligns_as_many_candidates_as_the_reference(spark):
    found = [r["count"] for r in QUERIES["paired_rerank_documents"](spark, SMALL).groupBy("query_idx").count().collect()]
    assert found == [min(200, spark.read.parquet(f"{SMALL}/documents.parquet").count())] * len(found)
