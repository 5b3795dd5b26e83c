"""Queries of the subpackage against their SQL, over whole small tables."""

import os

import pytest
from compare import same, tables

from relata.llm.queries import oracle_sql, queries

DATA = os.environ.get("RELATA_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert same(queries()[name](spark, DATA), tables(DATA), oracle_sql()[name]) == ""
