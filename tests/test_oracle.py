"""Every named query against an independent engine, over whole tables."""

import pytest

from outage_spark.plans.catalog import QUERIES
from outage_spark.plans.oracles import ORACLES
from tests.compare import assert_same, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert assert_same(df, con, ORACLES[name]) > 0
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
