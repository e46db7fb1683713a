"""Queries of this subpackage that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from gleanery.llm import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the shared tables aren't here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = registry.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    result = con.execute(registry.ORACLE_SQL[name])
    order = sorted((c[0], i) for i, c in enumerate(result.description))
    assert columns == [c for c, _ in order]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[i]) for _, i in order) for r in result.fetchall())
