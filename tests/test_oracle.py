"""Every registered query against its SQL form on the driver's tables."""

import os

import pytest

from brineframe.plans.registry import all_queries

from .oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


# no cross products, no nested loops, no Python evaluated per row
BANNED = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, con, name):
    df = QUERIES[name].run(spark, SF_DIR)
    problem, _ = compare(spark, con, QUERIES[name], SF_DIR, df)
    assert problem is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BANNED if b in plan]


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_model_queries_return_rows(spark, name):
    assert QUERIES[name].run(spark, SF_DIR).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["pruned_profile_scan"].run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate" in plan
