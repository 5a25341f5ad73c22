"""Every registered query with SQL against DuckDB on the smallest tables; the rest by their shape."""

import math
import os

import duckdb
import pytest

from folialis.plans import catalogue
from folialis.sources.tables import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    r = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(dict(zip(names, x, strict=True))[c]) for c in cols]) for x in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert "list_page" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0


def test_filters_reach_the_scan(spark):
    from folialis.operators import library
    from folialis.plans.library_queries import LIST, lib

    plan = library.filtered(lib(spark, SF), LIST).select("id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(year,2005)" in plan and "LeftSemi" in plan and "LeftAnti" in plan
    assert "fulltext" not in plan[plan.index("== Physical") :]
