"""Every registered query against its SQL, and that what has no SQL gives rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference
from tidemark.workload import catalog

SLOW = {"residual_forest_importances", "corrected_predictions", "residual_forest_metrics", "residual_forest_search"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.COVERS) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "severity" in df.columns


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, sf, con, name):
    assert difference(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - SLOW))
def test_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
