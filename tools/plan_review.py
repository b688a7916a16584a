"""Print the physical join/exchange operators of every registered query.

usage: python tools/plan_review.py [sf_dir] [query ...]
Flags plans holding a cartesian product or a nested-loop join, and shows
whether the scans prune columns and push filters down.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetaudit.plans.catalog import QUERIES  # noqa: E402
from fleetaudit.session import local_session  # noqa: E402

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")
OPS = re.compile(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|"
                 r"Exchange hashpartitioning|Window|InMemoryTableScan|Generate)")


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summarize(plan: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for m in OPS.finditer(plan):
        out[m.group(1)] = out.get(m.group(1), 0) + 1
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = set(sys.argv[2:])
    spark = local_session(8)
    flagged = 0
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        plan = physical_plan(fn(spark, sf_dir))
        bad = [b for b in BAD if b in plan]
        flagged += bool(bad)
        print(f"{name:22s} {'BAD ' + ','.join(bad) if bad else 'ok':8s} {summarize(plan)}")
    print("flagged", flagged)


if __name__ == "__main__":
    main()
