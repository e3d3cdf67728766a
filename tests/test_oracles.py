"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from driver_queries import ORACLES, QUERIES
from tests.oracle import compare, duck, sf_path


@pytest.fixture(scope="module")
def con():
    return duck(sf_path("0.001"))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, sf_path("0.001"))
    assert ok, message


def test_all_queries_have_a_twin():
    assert set(QUERIES) == set(ORACLES)
