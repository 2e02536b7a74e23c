"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import difference, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(ours)
    else:
        assert difference(ours, con.execute(sql).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
