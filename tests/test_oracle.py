"""Every registered query against its DuckDB twin at sf0.01 (the driver's
correctness gate); queries without SQL get a rows check."""

from __future__ import annotations

import pytest
from conftest import SF_ORACLE, SF_SMALL
from oracle_check import compare, duck

import __spark_entry__ as entry
from climatrix.plans.catalog import REGISTRY

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 1
    assert "tavg_mean" in df.columns


def test_keys_align():
    assert set(SQL) <= set(QUERIES)
    assert set(REGISTRY) <= set(SQL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_ORACLE)
    if name in SQL:
        assert compare(df, con, SQL[name]) == []
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["kpi_dashboard", "describe", "histogram", "resample_mean_w"])
def test_smoke_scale_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
