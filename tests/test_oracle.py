"""Every SQL-expressible registered query equals its DuckDB twin (sf0.001)."""

import pytest

from cellcube.plans import catalog
from cellcube.plans.check import compare, duckdb_con
from tests.conftest import SF_SMALL

NAMES = sorted(catalog.ORACLES)


@pytest.fixture(scope="module")
def con():
    return duckdb_con(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF_SMALL, catalog.QUERIES, catalog.ORACLES)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns[:3] == ["year", "month", "pixel_idx"]
    assert df.count() > 0
    assert set(E.queries()) >= set(E.oracle_sql())
