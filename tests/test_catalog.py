"""Every registered query gives the rows of its SQL."""

import pytest

import check
from catalog import REGISTRY

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_agrees_with_sql(spark, con, name):
    assert REGISTRY[name][1] is not None
    ok, note = check.compare(spark, con, SMALL, name)
    assert ok, note
