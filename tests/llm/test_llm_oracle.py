"""The opN queries that SQL can express, against their twins on the smallest tables."""

import pytest
from oracle import compare

from tidegrid.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLE[name]) == ""


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
