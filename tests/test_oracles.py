"""Every registered query against its oracle, on the smallest driver tables."""

import pytest

from tests.oracle import compare, connect
from tidemark.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_oracle(spark, connection, name):
    assert compare(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
