"""Every registered query next to its SQL counterpart."""

import pytest

import __spark_entry__ as entries
from compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entries.queries()))
def test_query(spark, con, name):
    ours = entries.queries()[name](spark, SF_DIR).toPandas()
    assert len(ours)
    sql = entries.oracle_sql().get(name)
    if sql is not None:
        assert difference(ours, con.execute(sql).df()) is None


def test_entry(spark):
    assert entries.entry(spark).count() > 0


def test_difference_can_fail(con):
    left = con.execute("SELECT 1 AS a, 2.0::DOUBLE AS b").df()
    assert difference(left, con.execute("SELECT 1 AS a, 2.000001::DOUBLE AS b").df())
    assert difference(left, con.execute("SELECT 1 AS a, 2.0::DOUBLE AS c").df())
    assert difference(left, con.execute("SELECT 1 AS a, 2.0::DOUBLE AS b UNION ALL SELECT 1, 2.0").df())
    assert difference(left, left) is None
