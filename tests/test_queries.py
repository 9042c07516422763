"""Every registered query against the same query in DuckDB."""

import pytest

from millrace import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, same, spark, data):
    if name in catalog.ORACLE_SQL:
        same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    else:
        assert catalog.QUERIES[name](spark, data).columns


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = catalog.QUERIES["filter"](spark, data).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan
    assert "l_returnflag" not in plan and "l_comment" not in plan


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
