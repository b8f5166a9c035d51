"""Every registered query against its SQL text on the smallest data set."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import same, views

D = "/root/testdata/sf0.001"
Q, O = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views(D)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(O) <= set(Q)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, con, name):
    got = Q[name](spark, D).toPandas()
    if name in O:
        assert same(got, con.execute(O[name]).df()) == ""
    else:
        assert len(got) > 0
