import pytest

import __spark_entry__ as entry
from screenloom.plans.oracles import ORACLES
from screenloom.plans.queries import QUERIES
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql_and_the_other_way_round():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, ORACLES[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["user_id", "captures", "total_chars", "activity_type", "times"]
