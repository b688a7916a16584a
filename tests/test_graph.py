"""Graph jobs on the original tool's graph cases (flask closure, cycles, shortest path, chains)."""

import random

import pytest
from pyspark.sql import functions as F

from fleetaudit.plans import graph, scan
from tests.conftest import rows

# small known-dependency graph written for the tests
EDGES = [
    ("flask", "werkzeug"), ("flask", "jinja2"), ("flask", "click"), ("flask", "itsdangerous"),
    ("flask", "markupsafe"), ("jinja2", "markupsafe"), ("werkzeug", "markupsafe"),
    ("requests", "urllib3"), ("requests", "certifi"), ("requests", "idna"),
]


def _edges(spark, extra=()):
    return spark.createDataFrame([("python", a, b) for a, b in list(EDGES) + list(extra)],
                                 "ecosystem string, parent string, child string")


def _deps(spark, names, pid=1, eco="python"):
    return spark.createDataFrame(
        [(pid, "requirements.txt", eco, i + 1, n, "1.0", None, None, None, None, "declared")
         for i, n in enumerate(names)],
        "project_id long, path string, ecosystem string, pos int, name string, version string, dep_type string, "
        "scope string, is_dev boolean, is_optional boolean, source string",
    )


def test_flask_closure(spark):
    r = graph.resolve(_deps(spark, ["Flask"]), _edges(spark))
    got = {x.name: (x.is_direct, x.depth, x.version) for x in r.collect()}
    assert got == {
        "flask": (True, 0, "1.0"), "werkzeug": (False, 1, "transitive"), "jinja2": (False, 1, "transitive"),
        "click": (False, 1, "transitive"), "itsdangerous": (False, 1, "transitive"),
        "markupsafe": (False, 1, "transitive"),
    }


def test_unknown_package_is_direct_leaf(spark):
    r = graph.resolve(_deps(spark, ["left-pad"]), _edges(spark))
    assert rows(r, "name", "is_direct", "depth") == [("left-pad", True, 0)]


def test_statistics(spark):
    e = _edges(spark)
    r = graph.resolve(_deps(spark, ["requests", "flask"]), e)
    st = graph.graph_stats(r, e).first()
    assert st.direct_dependencies == 2
    assert st.total_packages == st.direct_dependencies + st.transitive_dependencies == 10
    assert st.max_depth >= 1
    assert (st.most_depended_on, st.dependents_count) == ("markupsafe", 3)


def test_shortest_path(spark):
    extra = [("werkzeug", "zz-deep"), ("markupsafe", "zz-deep")]
    r = graph.resolve(_deps(spark, ["flask"]), _edges(spark, extra))
    paths = {x.name: x.dependency_path for x in graph.shortest_paths(r).collect()}
    assert paths["markupsafe"] == "flask -> markupsafe"
    assert paths["zz-deep"] == "flask -> markupsafe -> zz-deep"  # ties: smallest path
    assert "flask" not in paths  # a direct package's path is itself


def test_cycles(spark):
    e = spark.createDataFrame([("npm", "a", "b"), ("npm", "b", "c"), ("npm", "c", "a"), ("npm", "c", "d"),
                               ("npm", "x", "x")], "ecosystem string, parent string, child string")
    got = rows(graph.cycles(e).select("cycle", "length"), "cycle", "length")
    assert got == [(["a", "b", "c", "a"], 3), (["x", "x"], 1)]
    assert graph.cycles(_edges(spark)).count() == 0
    long = spark.createDataFrame([("npm", f"n{i:02d}", f"n{(i + 1) % 20:02d}") for i in range(20)]
                                 + [("npm", "n05", "tail")], "ecosystem string, parent string, child string")
    assert graph.cycle_nodes(long).count() == 20  # a 20-node loop: membership has no length limit
    (loop,) = graph.cycles(long).collect()  # and neither has the listing
    assert loop["length"] == 20 and loop["cycle"] == [f"n{i:02d}" for i in range(20)] + ["n00"]
    deps = spark.createDataFrame(
        [(1, "npm", 1, "n07", "1.0"), (2, "npm", 1, "tail", "1.0")],
        "project_id long, ecosystem string, pos int, name string, version string",
    ).selectExpr("*", "cast(null as string) dep_type", "'declared' source")
    stats = graph.graph_stats(graph.resolve(deps, long), long)
    assert rows(stats, "project_id", "circular_dependencies") == [(1, 1), (2, 0)]
    assert rows(graph.cycle_nodes(e), "name") == [("a",), ("b",), ("c",), ("x",)]


def test_chains(spark):
    e = _edges(spark)
    r = graph.resolve(_deps(spark, ["flask", "jinja2"]), e)
    ch = {tuple(x.chain) for x in graph.dependency_chains(r, e).filter(F.col("name") == "markupsafe").collect()}
    assert ch == {("flask", "markupsafe"), ("jinja2", "markupsafe"), ("flask", "werkzeug", "markupsafe")}


def test_blast_radius_and_nodes(spark):
    e = _edges(spark)
    deps = _deps(spark, ["flask"], pid=1).unionByName(_deps(spark, ["markupsafe", "requests"], pid=2))
    r = graph.resolve(deps, e)
    t = spark.createDataFrame([("python", "markupsafe")], "ecosystem string, package string")
    b = graph.blast_radius(r, t).first()
    assert (b.n_projects, b.n_direct, b.n_transitive, b.n_entry_packages) == (2, 1, 1, 1)
    nodes = {x.name: x for x in scan.graph_nodes(r.filter("project_id = 1"), e).collect()}
    assert (nodes["markupsafe"].n_depended_on_by, nodes["flask"].n_depends_on) == (3, 5)


def test_last_declaration_wins(spark):
    d = spark.createDataFrame(
        [(1, "package.json", "npm", 1, "react", "^17.0.2", "dependencies", None, False, False, "declared"),
         (1, "package.json", "npm", 2, "react", "^17.0.0", "peerDependencies", None, False, False, "declared"),
         (1, "package.json", "npm", None, "react", "17.0.2", "transitive", None, None, None, "installed")],
        "project_id long, path string, ecosystem string, pos int, name string, version string, dep_type string, "
        "scope string, is_dev boolean, is_optional boolean, source string",
    )
    n = graph.declared_nodes(d).first()
    assert (n.version, n.dep_type, n.first_pos, n.n_declarations) == ("17.0.2", "transitive", 1, 3)


def test_depth_compat(spark):
    e = _edges(spark)
    d = _deps(spark, ["flask", "jinja2", "requests"])
    r = graph.resolve(d, e)
    got = {x.name: (x.depth, x.depth_compat) for x in graph.depth_compat(d, r, e).collect()}
    assert got["jinja2"] == (0, 1)  # direct, and a child of the earlier-declared flask
    assert got["flask"] == (0, 0) and got["requests"] == (0, 0) and got["markupsafe"] == (1, 1)


def _reach(pairs):
    """Brute force: node -> all nodes it reaches by one edge or more."""
    nodes = {x for p in pairs for x in p}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            out[n] = out[n].union(*(out[m] for m in out[n])) if out[n] else out[n]
    return out


@pytest.mark.parametrize("seed, n, m", [(2, 30, 45), (4, 9, 40)])
def test_components_equal_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    pairs = {(eco, f"p{rng.randrange(n):02d}", f"p{rng.randrange(n):02d}") for _ in range(m) for eco in ("npm", "python")}
    want = []
    for eco in ("npm", "python"):
        reach = _reach([(a, b) for e, a, b in pairs if e == eco])
        for x in reach:
            if x in reach[x]:
                ring = {y for y in reach[x] if x in reach[y]}
                want.append((eco, min(ring), len(ring), x))
    e = spark.createDataFrame(sorted(pairs), "ecosystem string, parent string, child string")
    assert rows(graph.components(e), "ecosystem", "component", "size", "member") == sorted(want)
    assert rows(graph.cycle_nodes(e), "ecosystem", "name") == sorted((w[0], w[3]) for w in want)


def test_components_of_chained_rings_and_of_none(spark):
    # rings in a row, numbers against the direction of the edges: each ring has its own color
    pairs = [(f"r{9 - i}-{j}", f"r{9 - i}-{(j + 1) % 3}") for i in range(3) for j in range(3)]
    pairs += [(f"r{9 - i}-0", f"r{8 - i}-1") for i in range(2)] + [("r7-2", "tail0")] + [(f"tail{i}", f"tail{i + 1}") for i in range(4)]
    e = spark.createDataFrame([("npm", a, b) for a, b in pairs], "ecosystem string, parent string, child string")
    got = rows(graph.components(e), "component", "size", "member")
    assert got == sorted((f"r{9 - i}-0", 3, f"r{9 - i}-{j}") for i in range(3) for j in range(3))
    assert graph.components(e.filter("parent like 'tail%'")).collect() == []
    assert graph.components(e.limit(0)).collect() == []


def _all_chains(children, direct):
    """Brute force of the original tool's walk: package -> chains from a direct package, none inside."""
    parents = {}
    for a, b in children:
        parents.setdefault(b, set()).add(a)
    out = {}

    def up(node, path):
        if node in direct:
            return [list(reversed(path))]
        found = []
        for p in sorted(parents.get(node, ())):
            if p not in path:
                found += up(p, path + [p])
        return found

    reached = set(direct)
    grown = True
    while grown:
        grown = {b for a, b in children if a in reached and b not in reached}
        reached |= grown
    for node in reached:
        out[node] = sorted(up(node, [node]), key=lambda c: (len(c), c))
    return out


@pytest.mark.parametrize("seed, cyclic", [(2, False), (3, True)])
def test_counted_chains_equal_brute_force(spark, seed, cyclic):
    rng = random.Random(seed)
    pairs = set()
    for _ in range(34):
        a, b = rng.randrange(13), rng.randrange(13)
        if a != b:
            pairs.add((f"p{min(a, b):02d}", f"p{max(a, b):02d}"))
    if cyclic:
        pairs |= {("p07", "p03"), ("p09", "p08")}
    e = spark.createDataFrame([("npm", a, b) for a, b in sorted(pairs)], "ecosystem string, parent string, child string")
    names = {1: ["p00", "p01"], 2: ["p02", "p05", "p00"]}
    deps = _deps(spark, names[1], 1, "npm").unionByName(_deps(spark, names[2], 2, "npm"))
    targets = [f"p{i:02d}" for i in range(3, 13)]
    asked = spark.createDataFrame([("npm", t) for t in targets], "ecosystem string, package string")
    got = rows(graph.counted_chains(graph.resolve(deps, e), e, asked, k=2), "project_id", "name", "n_chains", "rank", "chain")
    want = []
    for pid, direct in names.items():
        for node, chains in _all_chains(pairs, direct).items():
            if node in targets:
                want += [(pid, node, len(chains), i, c) for i, c in enumerate(chains[:2], 1)]
    assert [(p, n, int(c), r, list(ch)) for p, n, c, r, ch in got] == sorted(want)
