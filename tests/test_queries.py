"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from gleanery.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the shared tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(float(v), 6) + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    result = duck.execute(catalog.ORACLE_SQL[name])
    order = sorted((c[0], i) for i, c in enumerate(result.description))
    assert columns == [c for c, _ in order]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for _, i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLE_SQL) <= set(entry.oracle_sql())
