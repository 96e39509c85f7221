"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle import compare

from tidegrid.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, registry.QUERIES[name], registry.ORACLE[name]) == ""


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["senior_id", "bucket", "steps_6h"]
