"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).
Each query is forced with the ``noop`` sink (full computation, nothing sent
to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetaudit.plans.catalog import QUERIES  # noqa: E402
from fleetaudit.session import clear_written, local_session  # noqa: E402

HEADLINE = [
    "parse_requirements",
    "parse_package_json",
    "parse_pom",
    "closure_depth",
    "vulnerable_deps",
    "outdated_deps",
    "typosquat_alerts",
    "license_alerts",
    "unregistered_deps",
    "pipeline_alerts",
    "secret_alerts",
    "history_secrets",
    "project_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = local_session(cpus, app="fleetaudit-bench", shuffle_partitions=int(cpus) * 2)
    # warm-up: each query once on the smallest data set (JVM JIT, Spark codegen caches), so the
    # timed pass measures execution at the target scale rather than one-time compilation
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    warm = 0.0
    if warm_dir and os.path.isdir(warm_dir) and warm_dir.rstrip("/") != sf_dir:
        t0 = time.time()
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
            spark.catalog.clearCache()
        warm = round(time.time() - t0, 3)
    else:
        QUERIES["declared_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()  # each query's caches and intermediate tables are its own
        clear_written(spark)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "warmup_seconds_at": [warm, warm_dir],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
