"""Every query gives the rows of its SQL oracle."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from sessionloom.plans import catalog
from tests.oracle import connect, differences

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf, con, name):
    difference = differences(QUERIES[name](spark, sf), con, ORACLES[name])
    # Too few rows for a full window at the smallest scale is fine; any other difference is not.
    assert difference in ("", "no rows")


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_gives_picks(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"group_id", "picks"}
