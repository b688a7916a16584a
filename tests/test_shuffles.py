"""How often rows travel: plans over small tables, without broadcasts."""

import contextlib
import tempfile

import pytest

from fleetaudit.operators import report
from fleetaudit.plans import graph, scan
from fleetaudit.sources import testdata
from tests.conftest import rows


@contextlib.contextmanager
def merged_only(spark):
    """Plans as for large tables: no broadcast, nothing changed while running."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sf_dir(spark):
    out = tempfile.mkdtemp(prefix="fleetaudit-shuffles-", dir="/tmp")
    spark.createDataFrame(
        [(k, f"blue ring {k}", f"Brand#{k % 3}", k % 9, 900.0 + k) for k in range(64)],
        "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double",
    ).write.parquet(f"{out}/part.parquet")
    spark.createDataFrame(
        [(o, (7 * o + line) % 64, o % 5, line, float(o % 50)) for o in range(40) for line in range(4)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double",
    ).write.parquet(f"{out}/lineitem.parquet")
    return out


def test_declared_packages_travel_to_their_project_once(spark, sf_dir):
    with merged_only(spark):
        nodes = graph.declared_nodes(testdata.TestData(spark, sf_dir).declared)
        # both sides of the join with the packages, then the rows by project
        assert plan(nodes).count("Exchange ") == 3
        assert nodes.count() == 160


def test_only_transitive_packages_travel_to_their_paths(spark):
    resolved = spark.createDataFrame(
        [(1, "npm", "a", "1", "x", True, 0, "a"), (1, "npm", "b", "transitive", "transitive", False, 1, "a"), (2, "npm", None, "1", "x", True, 0, None)],
        "project_id long, ecosystem string, name string, version string, dep_type string, is_direct boolean, depth int, root string")
    closure = spark.createDataFrame(
        [("npm", "a", "b", 1, ["a", "b"])], "ecosystem string, root string, node string, depth int, path array<string>")
    with merged_only(spark):
        out = graph.with_paths(resolved, closure)
        assert out.columns == ["project_id", "ecosystem", "name", "version", "dep_type", "is_direct", "depth", "path"]
        p = plan(out)
        assert "Union" in p and "NOT is_direct" in p
        got = {(r.project_id, r.name, tuple(r.path)) for r in out.collect()}
    assert got == {(1, "a", ("a",)), (1, "b", ("a", "b")), (2, None, (None,))}


def test_declared_rows_stay_while_the_closure_is_added(spark, sf_dir):
    with merged_only(spark):
        td = testdata.TestData(spark, sf_dir)
        resolved, closure = graph.resolve_roots(td.declared, td.edges)
        p = plan(resolved)
        assert "Union" in p
        top = p[: p.index("Union")]  # between the union and the grouping nothing travels
        assert "Exchange" not in top
        assert rows(resolved.filter("is_direct"), "project_id", "name") == rows(graph.declared_nodes(td.declared), "project_id", "name")


def test_alerts_of_resolved_packages_bring_their_path(spark):
    deps = spark.createDataFrame(
        [(p, "requirements.txt", "python", 1, "App", "1.0", None, None, None, None, "declared") for p in (1, 2, None)],
        "project_id long, path string, ecosystem string, pos int, name string, version string, dep_type string, "
        "scope string, is_dev boolean, is_optional boolean, source string")
    edges = spark.createDataFrame([("python", "app", "lib"), ("python", "lib", "core")], "ecosystem string, parent string, child string")
    advisories = spark.createDataFrame(
        [("python", name, f"CVE-{name}-{k}", "HIGH", "*", None, None) for name in ("app", "core") for k in range(3)],
        "ecosystem string, package string, cve string, severity string, affected_versions string, summary string, description string")
    names = spark.createDataFrame([], "ecosystem string, name string")
    packages = names.withColumnRenamed("name", "package")
    t = scan.ScanInputs(
        dependencies=deps, edges=edges, popular=names, advisories=advisories, licenses=packages.selectExpr("*", "package AS license"),
        releases=packages.selectExpr("*", "package AS version"), registry_names=spark.createDataFrame([("python", "app")], packages.schema))
    raw = scan.raw_alerts(t, ["vulnerabilities"])
    looked_up = report.enrich(raw, t.resolved_paths)
    alerts, _ = scan.scan_projects(t, ["vulnerabilities"])
    assert alerts.columns == looked_up.columns
    assert sorted(map(str, alerts.collect())) == sorted(map(str, looked_up.collect()))
    brought = alerts.filter("package = 'core' AND category = 'vulnerabilities' AND project_id = 1")
    assert {r.dependency_path for r in brought.collect()} == {"app -> lib -> core"}
    with merged_only(spark):  # a package's many alerts do not travel to its path
        alone = scan.enriched(t, [("vulnerabilities", scan.SCANNERS["vulnerabilities"][1](t))])
        assert "hashpartitioning(project_id" not in plan(alone)
