"""Every registered query against its SQL, on whole tables."""

import oracle
import pytest

import __spark_entry__ as entry
from martspark.plans.queries import ORACLES, QUERIES

# The text queries have tests of their own.
# No pairs of all rows with all rows, no rows through Python.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_all_have_sql_and_are_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in UNWANTED if node in plan]
    assert oracle.compare(df, con, ORACLES[name]) == []


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "last_trans_date", "frequency", "monetary", "recency"]
