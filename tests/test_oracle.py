"""Every registered query against its SQL twin, and what its plan must not hold."""

import pytest

import __spark_entry__ as entry_points
from compare import duck, duck_bag, spark_bag

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    got = spark_bag(df)
    if name in ORACLES:
        assert got == duck_bag(con, ORACLES[name])
    else:
        assert sum(got[1].values()) > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_is_the_risk_surface(spark):
    df = entry_points.entry(spark)
    assert {"cell_i", "cell_j", "slot", "profile", "cost", "rio", "passable"} <= set(df.columns)
    assert df.count() > 0
