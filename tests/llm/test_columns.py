"""Columns of the operators' results that SQL can express, held against DuckDB on the smallest tables."""

import duckdb
import pytest

from seqlode.llm import registry

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.COLUMN_QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    result = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    df = registry.COLUMN_QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(result.fetchall())
