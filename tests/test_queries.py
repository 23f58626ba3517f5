from __future__ import annotations

import pytest

from spanloom.plans import registry

from .oracle import by_sql, normal


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, small, name):
    assert normal(registry.QUERIES[name](spark, small).toPandas()) == normal(by_sql(registry.ORACLES[name], small))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
