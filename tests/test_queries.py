"""Every query against its SQL, and what its plan must not hold."""

import pytest
from check import open_tables, spark_result, sql_result

import __spark_entry__ as entry
from jobtrail import plans
from helpers import plan_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return open_tables(FOLDER)


def test_every_query_has_sql():
    assert plans.QUERIES.keys() == plans.ORACLES.keys()


def test_entry(spark):
    assert entry.entry(spark).columns == ["profile_id", "rank", "role_id", "score"]


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query_equals_sql(spark, db, name):
    got_schema, got = spark_result(spark, name, FOLDER)
    want_schema, want = sql_result(db, name)
    assert got_schema == want_schema
    assert got == want
    assert got


@pytest.mark.parametrize("name", plans.QUERIES)
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "InPandas"):
        assert node not in plan
