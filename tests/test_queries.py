"""Every registered query of the engine against its SQL on the smallest tables."""

import oracle
import pytest

from pairscope.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, data, name):
    assert oracle.differences(spark, data, registry.QUERIES[name], registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["detect_documents", "mode_als", "mode_multi", "mode_real", "mode_natural", "mode_pool", "mode_fields", "mode_gbm"])
def test_mode_returns_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry_point_lists_everything(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["field_a", "field_b", "score"]
