"""Landed feed loaders, the report summary and the scan plan."""

import json
import tempfile

from fleetaudit.operators import report
from fleetaudit.plans import scan
from fleetaudit.sources import feeds
from tests.conftest import rows


def _write(lines, suffix=".json"):
    f = tempfile.NamedTemporaryFile("w", suffix=suffix, delete=False, dir="/tmp")
    f.write(lines)
    f.close()
    return f.name


def test_known_deps_and_popular(spark):
    p = _write(json.dumps({"python": {"Flask": ["Jinja2", "click"]}, "npm": {"cors": ["vary"]}}, indent=2))  # many lines
    assert rows(feeds.load_edges(spark, p), "ecosystem", "parent", "child") == [
        ("npm", "cors", "vary"), ("python", "flask", "click"), ("python", "flask", "jinja2")]
    p2 = _write(json.dumps({"python": ["requests"], "npm": ["express"], "shared": ["docker"]}))
    pop = feeds.load_popular(spark, p2)
    assert rows(pop.filter("ecosystem = 'python'"), "name") == [("docker",), ("requests",)]
    assert rows(pop.filter("ecosystem = 'ruby'"), "name") == [("docker",), ("express",), ("requests",)]
    builtin = feeds.load_popular(spark)
    assert builtin.filter("ecosystem = 'python'").count() == 82
    assert builtin.filter("ecosystem = 'npm'").count() == 84
    assert builtin.filter("ecosystem = 'maven'").count() == 156


def test_advisory_feed(spark):
    node = {"advisory": {"cveId": "CVE-2023-1", "severity": "HIGH", "summary": "s", "description": "d"},
            "vulnerableVersionRange": "< 2.31.0"}
    bare = {"advisory": {}, "vulnerableVersionRange": None}
    line = {"ecosystem": "python", "package": "Requests",
            "response": {"data": {"securityVulnerabilities": {"nodes": [node, bare]}}}}
    adv = feeds.load_advisories(spark, _write(json.dumps(line) + "\n"))
    assert rows(adv, "package", "cve", "severity", "affected_versions") == [
        ("requests", "CVE-2023-1", "HIGH", "< 2.31.0"), ("requests", "Unknown", "UNKNOWN", "")]


def test_registry_feeds(spark):
    lines = [
        {"ecosystem": "python", "package": "a", "body": json.dumps(
            {"info": {"license": "", "version": "1.2.0",
                      "classifiers": ["Topic :: X", "License :: OSI Approved :: MIT License"]}})},
        {"ecosystem": "npm", "package": "b", "body": json.dumps({"license": {"type": "ISC"}, "version": "3.0.0"})},
        {"ecosystem": "ruby", "package": "c", "body": json.dumps({"licenses": ["MIT", "Apache-2.0"],
                                                                  "version": "7.1.3"})},
        {"ecosystem": "maven", "package": "g:a", "body": json.dumps(
            {"response": {"docs": [{"latestVersion": "4.13.2"}]}})},
    ]
    p = _write("\n".join(json.dumps(x) for x in lines) + "\n")
    assert rows(feeds.load_licenses(spark, p), "package", "license") == [
        ("a", "MIT License"), ("b", "ISC"), ("c", "MIT, Apache-2.0"), ("g:a", "Unknown")]
    assert rows(feeds.load_latest(spark, p), "package", "version") == [
        ("a", "1.2.0"), ("b", "3.0.0"), ("c", "7.1.3"), ("g:a", "4.13.2")]


def test_summary_score(spark):
    deps = spark.createDataFrame([(1, "a"), (1, "b")], "project_id long, name string")
    alerts = spark.createDataFrame([(1, "vulnerabilities", "HIGH")], "project_id long, category string, "
                                                                    "severity string")
    s = report.project_summary(deps, alerts).first()
    assert (s.total_dependencies, s.vulnerabilities_found, s.total_issues, s.security_score, s.band) == (
        2, 1, 1, 92, "SECURE")
    assert s.recommendations == ["Update 1 vulnerable packages to latest patched versions"]
    odd = spark.createDataFrame([(2, "vulnerabilities", "MODERATE"), (2, "licenses", None)],
                                "project_id long, category string, severity string")
    s2 = report.project_summary(deps.limit(0), odd).first()
    assert (s2.n_medium, s2.security_score) == (2, 94)


def test_scan_plan_with_plugin(spark):
    deps = spark.createDataFrame(
        [(1, "requirements.txt", "python", 1, "requess", "2.0.0", None, None, None, None, "declared")],
        "project_id long, path string, ecosystem string, pos int, name string, version string, dep_type string, "
        "scope string, is_dev boolean, is_optional boolean, source string")
    empty = "ecosystem string, package string"
    t = scan.ScanInputs(
        dependencies=deps,
        edges=spark.createDataFrame([], "ecosystem string, parent string, child string"),
        popular=spark.createDataFrame([("python", "requests")], "ecosystem string, name string"),
        advisories=spark.createDataFrame([], empty + ", cve string, severity string, affected_versions string, "
                                                  "summary string, description string"),
        licenses=spark.createDataFrame([], empty + ", license string"),
        releases=spark.createDataFrame([("python", "requess", "2.1.0")], empty + ", version string"),
        registry_names=spark.createDataFrame([("python", "requess")], empty),
    )
    scan.register_scanner("always_one", "artifacts", lambda t: t.dependencies.select(
        "project_id", "ecosystem", "name").withColumnRenamed("name", "package").selectExpr(
        "*", "'ARTIFACT' AS type", "'LOW' AS severity", "'x' AS message"))
    alerts, summary = scan.scan_projects(t, ["typosquatting", "always_one"])
    assert rows(alerts, "category", "type") == [("artifacts", "ARTIFACT"), ("typosquatting", "TYPOSQUATTING"),
                                                ("versions", "OUTDATED_PACKAGE")]
    s = summary.first()
    assert (s.typosquatting_alerts, s.versions_outdated, s.artifact_issues, s.total_issues) == (1, 1, 1, 3)
    del scan.SCANNERS["always_one"]


def test_sinks(spark):
    from fleetaudit.plans import graph
    from fleetaudit.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).rstrip("/") + "/sink-test"
    summary = spark.createDataFrame([(1, 92)], "project_id long, security_score int")
    alerts = report.to_alerts(spark.createDataFrame([(1, "x", "HIGH")], "project_id long, package string, "
                                                                     "severity string"), "vulnerabilities")
    report.write_report(summary, alerts, base + "/report")
    assert spark.read.json(base + "/report/summary").first().security_score == 92
    assert spark.read.parquet(base + "/report/alerts").first().category == "vulnerabilities"
    edges = spark.createDataFrame([("python", "a", "b")], "ecosystem string, parent string, child string")
    deps = spark.createDataFrame(
        [(1, "r.txt", "python", 1, "a", "1", None, None, None, None, "declared")],
        "project_id long, path string, ecosystem string, pos int, name string, version string, dep_type string, "
        "scope string, is_dev boolean, is_optional boolean, source string")
    scan.write_graph(graph.resolve(deps, edges), edges, base + "/graph")
    got = {r.name: r.n_depends_on for r in spark.read.json(base + "/graph/nodes").collect()}
    assert got == {"a": 1, "b": 0}
    assert [(r.parent, r.child) for r in spark.read.parquet(base + "/graph/edges").collect()] == [("a", "b")]


def test_one_document_per_project(spark, tmp_path):
    summary = spark.createDataFrame([(1, 92, ["a"]), (2, 100, []), (3, 50, [])], "project_id long, security_score int, recommendations array<string>")
    found = [(1, f"p{i}", "HIGH", 'say "hi"\n') for i in range(40)] + [(3, "x", "LOW", None), (9, "y", "LOW", None)]
    alerts = report.to_alerts(spark.createDataFrame(found, "project_id long, package string, severity string, message string"), "vulnerabilities")
    more = report.to_alerts(spark.createDataFrame([(1, "q", "LOW")], "project_id long, package string, severity string"), "versions")
    report.write_documents(summary, report.union_alerts([alerts, more]), f"{tmp_path}/docs")
    docs = {}
    for r in spark.read.text(f"{tmp_path}/docs", wholetext=True).collect():
        d = json.loads(r["value"])
        assert d["project_id"] == r["project_id"] and d["project_id"] not in docs
        docs[d["project_id"]] = d
    assert sorted(docs) == [1, 2, 3]
    assert docs[1]["summary"] == {"security_score": 92, "recommendations": ["a"]}
    assert sorted(a["package"] for a in docs[1]["vulnerabilities"]) == sorted(f"p{i}" for i in range(40))
    assert docs[1]["vulnerabilities"][0]["message"] == 'say "hi"\n' and [a["package"] for a in docs[1]["versions"]] == ["q"]
    assert all(docs[2][c] == [] for c in report.CATEGORIES) and len(docs[3]["vulnerabilities"]) == 1
