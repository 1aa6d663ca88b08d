"""Plan guards over the registered queries: no cartesian / nested-loop joins,
no Python UDF operators, scans read only the columns a query needs."""

import re

import pytest

import __spark_entry__ as E
from revisit.session import release_intermediates

from .conftest import SMALL

FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython")


#: The library's own queries; those of the text operators are tested in tests/llm.
OWN = E._registry()


@pytest.mark.parametrize("key", sorted(k for k, (_, sql) in OWN.items() if sql))
def test_plan_has_no_cross_join_or_python_udf(spark, key):
    df = OWN[key][0](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    release_intermediates()
    assert not FORBIDDEN.search(plan), FORBIDDEN.search(plan).group(0)


def test_flagship_prunes_and_pushes(spark):
    from revisit.plans.cohort import readmission_rate_by_type
    df = readmission_rate_by_type(spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    release_intermediates()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    orders = next(s for s in scans if "orders.parquet" in s)
    # only the four order columns the journey needs are read
    assert re.search(r"FileScan parquet \[o_orderkey#\d+L?,o_custkey#\d+L?,o_orderdate#\d+,o_orderpriority#\d+\]",
                      orders)
    lineitem = next(s for s in scans if "lineitem.parquet" in s)
    assert "l_extendedprice" not in lineitem and "PushedFilters: [IsNotNull(l_orderkey)" in lineitem
