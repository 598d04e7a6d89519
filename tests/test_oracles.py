"""Every registered query against DuckDB over the same files."""

import os

import pytest

from tablecraft.suite import ORACLES, QUERIES
from tests.compare import connect, duck_rows, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_answer():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = spark_rows(QUERIES[name](spark, SF_DIR))
    wanted = duck_rows(duck, ORACLES[name])
    assert found[0] == wanted[0]
    assert found[1] == wanted[1]
