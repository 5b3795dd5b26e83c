import os

import pytest
from compare import same, tables

from relata.plans.oracle import oracle
from relata.plans.queries import QUERIES, flagship

DATA = os.environ.get("RELATA_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return tables(DATA)


@pytest.mark.parametrize("name", sorted(oracle()))
def test_query_equals_sql(spark, con, name):
    assert same(QUERIES[name](spark, DATA), con, oracle()[name]) == ""


def test_others_run(spark):
    for name in sorted(QUERIES.keys() - oracle().keys()):
        assert QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    rows = flagship(spark, DATA).groupBy("seq_id").agg({"pos": "max", "is_target": "max"}).collect()
    assert len(rows) == 1500 and all(r["max(pos)"] < 1024 and r["max(is_target)"] for r in rows)
