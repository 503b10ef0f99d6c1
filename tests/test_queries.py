"""Every registered query against its independent SQL twin."""

import os

import pytest
from compare import compare, connect

from clausegrid.plans.catalog import registry

SF = os.environ.get("CLAUSEGRID_SF", "/root/testdata/sf0.001")
FOUND = registry()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", FOUND)
def test_query(spark, con, name):
    query, sql = FOUND[name]
    if sql is None:
        assert query(spark, SF).count() >= 0
        return
    diff, rows = compare(spark, SF, con, name, query, sql)
    assert diff is None
    assert rows > 0


def test_every_query_has_a_twin():
    assert [n for n, (_, sql) in FOUND.items() if sql is None] == []
