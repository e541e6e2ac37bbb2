"""Every registered query against its SQL on the smallest tables."""

import pytest

from embergrid.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_rows_only_queries_run(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_points_name_each_other(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
