"""Steps that are done once: per text, per stream, per project."""

import glob

from fleetaudit.operators import outdated
from fleetaudit.plans import graph, scan
from fleetaudit.sources import manifests as M
from fleetaudit.streaming import alerts as stream
from tests.test_shuffles import merged_only, plan


def test_a_pom_is_read_once_whatever_its_dependencies(spark):
    dep = "<dependency><groupId>g</groupId><artifactId>a{0}</artifactId><version>${{v{0}}}</version></dependency>"
    text = "<project><properties><v1>1.0</v1><v2>2.0</v2></properties>" + dep.format(1) + dep.format(2) + "</project>"
    df = spark.createDataFrame(
        [(1, "pom.xml", "maven", text), (2, "pom.xml", "maven", "<project>"), (3, "pom.xml", "maven", None)],
        "project_id long, path string, ecosystem string, content string")
    out = M.pom_deps(df)
    said = plan(out)
    assert said.count("<properties") == 1 and said.count("<!--") == 1
    assert sorted((r.project_id, r.pos, r.name, r.version) for r in out.collect()) == [(1, 1, "g:a1", "1.0"), (1, 2, "g:a2", "2.0")]


def test_releases_are_looked_up_once_for_all_batches(spark, tmp_path, monkeypatch):
    calls, real = [], outdated.latest_release
    monkeypatch.setattr(outdated, "latest_release", lambda r: calls.append(1) or real(r))
    for k in range(5):  # one file each, four files a micro-batch
        m = spark.createDataFrame([(k, "requirements.txt", "python", "app==1.0\n")], "project_id long, path string, ecosystem string, content string")
        stream.land_manifests(spark, m.coalesce(1), f"{tmp_path}/in")
    releases = spark.createDataFrame([("python", "app", "2.0")], "ecosystem string, package string, version string")
    out = stream.stream_outdated(spark, f"{tmp_path}/in", releases, f"{tmp_path}/out")
    assert sorted((r.project_id, r.latest_version) for r in out.collect()) == [(k, "2.0") for k in range(5)]
    assert len(calls) == 1


def test_micro_batches_are_bounded_by_bytes_not_by_a_few_files(spark, tmp_path, monkeypatch):
    m = spark.createDataFrame(
        [(k, "requirements.txt", "python", "app==1.0\n") for k in range(9)],
        "project_id long, path string, ecosystem string, content string").repartition(9, "project_id")
    for k in range(9):  # one file each
        m.filter(f"project_id = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    releases = spark.createDataFrame([("python", "app", "2.0")], "ecosystem string, package string, version string")
    found = {}
    for size in (stream.BATCH_BYTES, 1):
        monkeypatch.setattr(stream, "BATCH_BYTES", size)
        out = stream.stream_outdated(spark, f"{tmp_path}/in", releases, f"{tmp_path}/out-{size}")
        found[len(glob.glob(f"{tmp_path}/out-{size}/alerts/batch_id=*"))] = sorted(map(str, out.collect()))
    # small files share one micro-batch (before: four a batch); a bound below a file's size takes them one by one
    assert set(found) == {1, 9} and found[1] == found[9] and len(found[1]) == 9


def _resolved(spark):
    rows = [(p, "npm", n, d, i, r) for p in (1, 2, None) for n, d, i, r in (("a", True, 0, "a"), ("b", False, 1, "a"), ("c", False, 2, "a"))]
    resolved = spark.createDataFrame(
        [(p, e, n, "1", "x", d, i, r) for p, e, n, d, i, r in rows],
        "project_id long, ecosystem string, name string, version string, dep_type string, is_direct boolean, depth int, root string")
    edges = spark.createDataFrame([("npm", "a", "b"), ("npm", "b", "c"), ("npm", "a", "c")], "ecosystem string, parent string, child string")
    return resolved, edges


def test_a_projects_rows_and_edges_are_joined_in_place(spark):
    resolved, edges = _resolved(spark)
    with merged_only(spark):
        nodes, tree, stats = scan.graph_nodes(resolved, edges), scan.tree_view(resolved, edges, 2), graph.graph_stats(resolved, edges)
        # both groupings of the edges stay in place: 10, 5 and 12 exchanges otherwise
        assert [plan(df).count("Exchange ") for df in (nodes, tree)] == [8, 4]
        assert plan(stats).count("Exchange ") < 12
        assert sorted((r.name, r.n_depends_on, r.n_depended_on_by) for r in nodes.filter("project_id = 1").collect()) == [("a", 2, 0), ("b", 1, 1), ("c", 0, 2)]
        assert {r.n_depends_on for r in nodes.filter("project_id IS NULL").collect()} == {0}
        assert sorted((r.name, r.n_children) for r in tree.filter("project_id = 2").collect()) == [("a", 2), ("b", 1)]
        assert {(r.most_depended_on, r.dependents_count) for r in stats.filter("project_id = 1").collect()} == {("c", 2)}


def test_chains_are_joined_once_a_round(spark):
    resolved, edges = _resolved(spark)
    with merged_only(spark):
        chains = graph.dependency_chains(resolved, edges)
        assert "Join" not in plan(chains)
        assert sorted(tuple(r.chain) for r in chains.filter("project_id = 1").collect()) == [("a", "b"), ("a", "b", "c"), ("a", "c")]
        # rows without a project have no known parents
        assert sorted(tuple(r.chain) for r in chains.filter("project_id IS NULL").collect()) == [("b",), ("c",)]
        targets = spark.createDataFrame([("npm", "c")], "ecosystem string, package string")
        best = graph.counted_chains(resolved, edges, targets, 1).filter("project_id = 1").collect()
        assert [(r.name, int(r.n_chains), r.rank, tuple(r.chain)) for r in best] == [("c", 2, 1, ("a", "c"))]
