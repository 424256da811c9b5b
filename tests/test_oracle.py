"""Every registered query against its SQL, whole results, on the smallest tables."""

import pytest

from __spark_entry__ import entry
from plumbline.catalog.registry import ORACLES, QUERIES
from tests import harness


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    rows, problem, _ = harness.compare(spark, con, name, QUERIES, ORACLES, f"{harness.DATA}/sf0.001")
    assert problem is None
    assert rows >= 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    result = entry(spark)
    assert result.columns == ["arm", "slice", "metric", "value"]
    assert result.limit(1).count() == 1
