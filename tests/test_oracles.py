"""Every query against its SQL twin, at the smallest scale."""

import pytest

from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name], SF) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["window_end", "rk", "tag", "cnt"]
    # Operators of the subpackage that SQL can't express have no twin; those of the feed all have.
    assert QUERIES.keys() <= __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
