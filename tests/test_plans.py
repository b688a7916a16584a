"""Plan shape checks on registered queries: no cartesian products or nested-loop joins,
column pruning at the parquet scans, the look-alike join broadcast."""

import os

import pytest

from fleetaudit.plans.catalog import QUERIES
from tools.plan_review import BAD, physical_plan

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

PLAN_QUERIES = ["vulnerable_deps", "outdated_deps", "typo_candidates", "license_alerts", "unregistered_deps",
                "pipeline_alerts", "secret_alerts", "graph_stats", "project_summary"]


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = physical_plan(QUERIES[name](spark, SF))
    assert not any(b in plan for b in BAD), name


def test_scans_are_pruned(spark):
    plan = physical_plan(QUERIES["outdated_deps"](spark, SF))
    # lineitem is read for five of its columns only
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int," \
           "l_quantity:double>" in plan


def test_typo_join_is_broadcast(spark):
    plan = physical_plan(QUERIES["typo_candidates"](spark, SF))
    assert "BroadcastHashJoin" in plan and "BroadcastExchange" in plan
