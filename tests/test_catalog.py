"""Every registered query against DuckDB on the test tables."""

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_entry(spark):
    found = entry(spark)
    assert found.count() > 0
    assert found.columns[:3] == ["model", "slice", "slice_value"]


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    found = queries()[name](spark, SF_DIR)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    sql = oracle_sql().get(name)
    if sql is None:
        assert found.count() > 0
    else:
        assert compare.difference(found, duck, sql) is None
