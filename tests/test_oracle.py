"""Every query of the engine against its SQL, on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import compare, connect

NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql:
        assert compare(df, con, sql) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
