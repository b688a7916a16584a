"""Small operators not covered elsewhere: NVD feed, snapshot refresh, neighbours, manual edges,
secret projection, project-tree reader."""

import json
import os
import tempfile

from fleetaudit.operators import textscan
from fleetaudit.plans import graph
from fleetaudit.session import ensure_checkpoint_dir
from fleetaudit.sources import feeds
from tests.conftest import rows


def test_nvd_feed(spark):
    item = {"cve": {"CVE_data_meta": {"ID": "CVE-2020-1"}, "description": {"description_data": [{"value": "x"}]}},
            "impact": {"baseMetricV3": {"cvssV3": {"baseSeverity": "CRITICAL"}}}}
    bare = {"cve": {"CVE_data_meta": {"ID": "CVE-2020-2"}, "description": {"description_data": [{"value": "y"}]}}}
    line = {"ecosystem": "python", "package": "Pkg", "response": {"result": {"CVE_Items": [item, bare]}}}
    f = tempfile.NamedTemporaryFile("w", suffix=".json", delete=False, dir="/tmp")
    f.write(json.dumps(line) + "\n")
    f.close()
    assert rows(feeds.load_nvd(spark, f.name), "package", "cve", "severity", "description") == [
        ("pkg", "CVE-2020-1", "CRITICAL", "x"), ("pkg", "CVE-2020-2", "UNKNOWN", "y")]


def test_refresh_snapshot(spark):
    path = ensure_checkpoint_dir(spark).rstrip("/") + "/snapshot-test"
    a = spark.createDataFrame([("npm", "a", "MIT")], "ecosystem string, package string, license string")
    feeds.refresh_snapshot(spark, path, a)
    b = spark.createDataFrame([("npm", "a", "GPL"), ("npm", "b", "Unknown")],
                              "ecosystem string, package string, license string")
    snap = feeds.refresh_snapshot(spark, path, b)
    # a key is looked up once: the first value stays, new keys (negative results too) are added
    assert rows(snap, "package", "license") == [("a", "MIT"), ("b", "Unknown")]


def test_neighbours_and_manual_edges(spark):
    e = spark.createDataFrame([("python", "flask", "jinja2"), ("python", "jinja2", "markupsafe")],
                              "ecosystem string, parent string, child string")
    down, up = graph.neighbours(e, "Jinja2")
    assert rows(down, "name") == [("markupsafe",)] and rows(up, "name") == [("flask",)]
    extra = spark.createDataFrame([("python", "Flask", "click"), ("python", "flask", "jinja2")],
                                  "ecosystem string, parent string, child string")
    assert graph.add_edges(e, extra).count() == 3


def test_secret_projection(spark):
    files = spark.createDataFrame([(1, "a.py", "token = 'abcdefghijklmnop1234'\n")],
                                  "project_id long, path string, content string")
    p = textscan.secret_projection(textscan.secret_alerts(files))
    assert p.columns == ["project_id", "type", "file", "severity", "description", "line", "commit"]
    assert rows(p, "type", "line") == [("GENERIC_SECRET", 1)]


def test_read_project_tree(spark):
    root = tempfile.mkdtemp(prefix="tree-", dir="/tmp")
    os.makedirs(f"{root}/p1/.github/workflows")
    with open(f"{root}/p1/.github/workflows/ci.yml", "w") as f:
        f.write("steps:\n  - run: curl -s https://x | sh\n")
    with open(f"{root}/p1/requirements.txt", "w") as f:
        f.write("flask==2.0\n")
    t = feeds.read_project_tree(spark, root)
    assert rows(t, "project_id", "path") == [("p1", ".github/workflows/ci.yml"), ("p1", "requirements.txt")]
    assert rows(textscan.pipeline_alerts(t), "file", "pattern_name") == [(".github/workflows/ci.yml", "CURL_BASH")]


def test_directory_scan_end_to_end(spark):
    from fleetaudit.plans import scan

    root = tempfile.mkdtemp(prefix="tree-", dir="/tmp")
    files = {
        "web/package.json": '{"dependencies": {"expres": "^4.0.0", "@corp/ui": "1.0.0"}}',
        "web/node_modules/left-pad/package.json": '{"version": "1.3.0"}',
        "web/.npmrc": "registry=https://npm.corp/\n",
        "web/.github/workflows/ci.yml": "steps:\n  - uses: actions/checkout@main\n",
        "web/docs/notes.txt": "not a manifest==1.0\n",
        "api/requirements.txt": "django==3.2.0\n",
        "api/settings.py": "PASSWORD = 'hunter2hunter2'\n",
    }
    for rel, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
        with open(f"{root}/{rel}", "w") as f:
            f.write(text)
    tree = feeds.read_project_tree(spark, root)

    def empty(schema):
        return spark.createDataFrame([], schema)

    t = scan.inputs_from_tree(
        tree,
        edges=empty("ecosystem string, parent string, child string"),
        popular=spark.createDataFrame([("npm", "express")], "ecosystem string, name string"),
        advisories=empty("ecosystem string, package string, cve string, severity string, affected_versions string, "
                         "summary string, description string"),
        licenses=empty("ecosystem string, package string, license string"),
        releases=empty("ecosystem string, package string, version string"),
        registry_names=spark.createDataFrame([("npm", "expres"), ("npm", "left-pad"), ("python", "django")],
                                             "ecosystem string, package string"),
    )
    assert rows(t.dependencies, "project_id", "name", "source") == [
        ("api", "django", "declared"), ("web", "@corp/ui", "declared"), ("web", "expres", "declared"),
        ("web", "left-pad", "installed")]
    alerts, summary = scan.scan_projects(t, scan.DEFAULT_SCANS + ["secrets"])
    got = rows(alerts, "project_id", "category", "type")
    assert ("web", "typosquatting", "TYPOSQUATTING") in got
    assert ("web", "dep_confusion", "DEPENDENCY_CONFUSION") in got      # @corp/ui unregistered
    assert ("web", "dep_confusion", "DEP_CONFUSION_CONFIG") in got      # .npmrc default registry
    assert ("web", "pipeline", "PIPELINE_RISK") in got                  # unpinned action
    assert ("api", "versions", "OUTDATED_PACKAGE") in got               # built-in latest for django
    assert ("api", "secrets", "PASSWORD_ASSIGNMENT") in got
    assert {r.project_id: r.total_dependencies for r in summary.collect()} == {"api": 1, "web": 3}


def test_rows_that_repeat_or_tie(spark):
    import pytest

    from fleetaudit.operators import confusion, licensing, outdated

    resolved = spark.createDataFrame(
        [(1, "python", "a", "1"), (1, "npm", "b", "1"), (2, "python", "a", "1")],
        "project_id long, ecosystem string, name string, version string")
    lic = spark.createDataFrame(
        [("python", "a", "GPL-3.0"), ("python", "a", "unknown"), ("python", "a", "GPL-3.0"), ("npm", "b", "Proprietary")],
        "ecosystem string, package string, license string")
    got = licensing.license_alerts(resolved, lic).select("project_id", "type").collect()
    # a conflict counts over all ecosystems of a project; a repeated licence row does not repeat its alert
    assert sorted(map(tuple, got)) == [(1, "LICENSE_CONFLICT"), (1, "LICENSE_RISK"), (2, "LICENSE_RISK")]
    rel = spark.createDataFrame([("npm", "x", "1.0"), ("npm", "x", "1.0.0")], "ecosystem string, package string, version string")
    assert {outdated.latest_release(rel.orderBy(o)).first()["latest"] for o in ("version", "package")} == {"1.0.0"}
    with pytest.raises(ValueError):
        confusion.unregistered_alerts(resolved, rel.select("ecosystem", "package").limit(0))


def test_streams_resume_in_their_folder(spark, tmp_path):
    from fleetaudit.streaming import alerts as stream

    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(3)
    at = f"{tmp_path}/in"
    base.write.parquet(at)
    first = stream.windowed_alert_counts(spark, at, f"{tmp_path}/out")
    n = first.groupBy().sum("n_alerts").first()[0]
    base.write.mode("append").parquet(at)  # arrives after the first run: the second run reads only these
    again = stream.windowed_alert_counts(spark, at, f"{tmp_path}/out")
    late = again.groupBy().sum("n_alerts").first()[0]
    assert n == 3 and late >= n  # a folder that forgot its state would count the old rows again or lose them


def test_arrivals_count_once(spark, tmp_path):
    """Landing again, or resuming, adds nothing; a new content adds its own alerts."""
    from fleetaudit.streaming import alerts as stream

    schema = "project_id long, path string, ecosystem string, content string"
    first = spark.createDataFrame([(i, "requirements.txt", "python", "flask==1.0\nnumpy==0.1") for i in range(5)], schema)
    releases = spark.createDataFrame([("python", "flask", "2.0"), ("python", "numpy", "1.0")], "ecosystem string, package string, version string")
    landing, out = f"{tmp_path}/landing", f"{tmp_path}/out"
    stream.land_manifests(spark, first.unionByName(first.limit(2)), landing)
    assert stream.stream_outdated(spark, landing, releases, out).count() == 10
    stream.land_manifests(spark, first, landing)
    assert spark.read.parquet(landing).count() == 5
    assert stream.stream_outdated(spark, landing, releases, out).count() == 10
    changed = spark.createDataFrame([(0, "requirements.txt", "python", "flask==1.1")], schema)
    stream.land_manifests(spark, first.unionByName(changed), landing)
    again = stream.stream_outdated(spark, landing, releases, out)
    assert again.count() == 11
    whole = stream.stream_outdated(spark, landing, releases, f"{tmp_path}/anew")  # resumed equals all at once
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))
