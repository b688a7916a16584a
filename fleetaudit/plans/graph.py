"""Dependency graph jobs.

The closure is computed once per distinct root ``(ecosystem, package)`` —
never once per project — with a driver-side hop loop of equi-joins
(frontier ⋈ edges, anti-join visited), reliable checkpoints every few hops to
cut lineage, and a stop on an empty frontier.  Projects then pick up the
closure of each of their declared roots with one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetaudit.session import checkpoint, dealt, written

CHECKPOINT_EVERY = 3


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        "ecosystem", F.lower("parent").alias("parent"), F.lower("child").alias("child")
    ).distinct()


def declared_nodes(dependencies: DataFrame) -> DataFrame:
    """One row per declared (project, ecosystem, name).

    The later declaration wins for ``dep_type`` and for ``version`` (a
    ``transitive`` version only when nothing else was declared); installed npm
    rows come after the manifest's rows.  ``first_pos`` keeps the first position.
    """
    d = dependencies.withColumn("name", F.lower("name"))
    order = F.struct(
        F.when(F.col("source") == "installed", 1).otherwise(0).alias("r"),
        F.coalesce(F.col("pos"), F.lit(2**31 - 1)).alias("p"),
    )
    d = d.withColumn("ord", order).withColumn("dep_type", F.coalesce(F.col("dep_type"), F.lit("direct")))
    real_version = F.when(F.col("version") != "transitive", F.struct("ord", "version"))
    return d.groupBy("project_id", "ecosystem", "name").agg(
        F.coalesce(F.max(real_version)["version"], F.min_by("version", "ord")).alias("version"),
        F.max_by("dep_type", "ord").alias("dep_type"),
        F.min("pos").alias("first_pos"),
        F.count("*").alias("n_declarations"),
    )


def root_closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """G1/G2/G5 per distinct root: ecosystem, root, node, depth (>= 1), path (root first).

    Only proper descendants are returned (a root is its own depth-0 node).
    ``path`` is the smallest shortest path by (length, lexicographic order).
    Only roots that have children enter the hop loop; the loop ends when a
    hop finds no new (root, node) pair, which always happens (pairs are finite
    and never revisited), so there is no hop limit.
    """
    e = _edges(edges).persist()  # used by every hop
    parents = e.select("ecosystem", F.col("parent").alias("root")).distinct()
    start = (
        roots.select("ecosystem", F.lower("root").alias("root")).distinct()
        .join(parents, ["ecosystem", "root"], "left_semi")
        .select("ecosystem", "root", F.col("root").alias("node"), F.lit(0).alias("depth"),
                F.array(F.col("root")).alias("path"))
    )
    start = start.persist()
    cached: list[DataFrame] = [start]
    frontier = start
    visited = start
    hop = 0
    while True:
        hop += 1
        step = (
            frontier.withColumnRenamed("node", "parent")
            .join(e, ["ecosystem", "parent"])
            .select("ecosystem", "root", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"),
                    F.concat(F.col("path"), F.array(F.col("child"))).alias("path"))
            .join(visited.select("ecosystem", "root", "node"), ["ecosystem", "root", "node"], "left_anti")
            .groupBy("ecosystem", "root", "node")
            .agg(F.min(F.struct("depth", "path")).alias("best"))
            .select("ecosystem", "root", "node", "best.depth", "best.path")
        )
        if hop % CHECKPOINT_EVERY == 0:
            step = checkpoint(step)
        else:
            step = step.persist()
            cached.append(step)
        if step.isEmpty():
            break
        visited = visited.unionByName(step)
        if hop % CHECKPOINT_EVERY == 0:
            visited = checkpoint(visited)
        frontier = step
    # the finished closure is written to the shared checkpoint folder: consumers read it
    # back instead of replaying the hop loop, and a lost executor does not lose it
    done = checkpoint(visited.filter(F.col("depth") > 0))
    cached.append(e)
    for df in cached:  # the checkpointed closure no longer needs the per-hop caches
        df.unpersist()
    return done


def resolve_roots(dependencies: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1 without paths: (declared roots ∪ their closure per project, the closure per root).

    Columns: project_id, ecosystem, name, version, dep_type, is_direct, depth, root.
    ``root`` is the direct package that the shortest path starts from.  A path
    begins with its root and is unique per (root, node), so the least
    (depth, root) picks the same path as the least (depth, path) would, and no
    path travels through the shuffle.
    """
    nodes = declared_nodes(dependencies).select("project_id", "ecosystem", "name", "version", "dep_type")
    nodes = nodes.persist()  # roots and per-project rows both read it
    closure = root_closure(nodes.select("ecosystem", F.col("name").alias("root")), edges)
    reached = (
        nodes.select("project_id", "ecosystem", F.col("name").alias("root"))
        .join(closure.select("ecosystem", "root", "node", "depth"), ["ecosystem", "root"])
        .select("project_id", "ecosystem", "node", F.struct("depth", "root").alias("best"),
                F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("dep_type"),
                F.lit(False).alias("is_direct"))
    )
    direct = nodes.select(
        "project_id", "ecosystem", F.col("name").alias("node"),
        F.struct(F.lit(0).alias("depth"), F.col("name").alias("root")).alias("best"),
        "version", "dep_type", F.lit(True).alias("is_direct"),
    )
    # both sides are dealt out by project, so the declared rows, most of all, stay where they are
    g = direct.unionByName(dealt(reached, "project_id")).groupBy("project_id", "ecosystem", "node").agg(
        F.min("best").alias("best"),
        F.max("is_direct").alias("is_direct"),
        F.max("version").alias("version"),  # only the direct row carries one
        F.max("dep_type").alias("dep_type"),
    )
    is_direct = F.col("is_direct")
    resolved = g.select(
        "project_id",
        "ecosystem",
        F.col("node").alias("name"),
        F.when(is_direct, F.col("version")).otherwise(F.lit("transitive")).alias("version"),
        F.when(is_direct, F.col("dep_type")).otherwise(F.lit("transitive")).alias("dep_type"),
        is_direct.alias("is_direct"),
        F.col("best.depth").alias("depth"),
        F.col("best.root").alias("root"),
    )
    return resolved, closure


def with_paths(resolved: DataFrame, closure: DataFrame) -> DataFrame:
    """``resolve_roots`` output with ``path``: looked up per (root, node), ``[name]`` for direct packages.

    ``resolved`` is read twice (written before, best): only transitive rows travel to their paths.
    """
    paths = closure.select("ecosystem", "root", F.col("node").alias("name"), "path")
    columns = ["project_id", "ecosystem", "name", "version", "dep_type", "is_direct", "depth"]
    direct = resolved.filter("is_direct").select(*columns, F.array("name").alias("path"))
    transitive = resolved.filter("NOT is_direct").join(paths, ["ecosystem", "root", "name"], "left")
    return direct.unionByName(transitive.select(*columns, "path"))


def resolve(dependencies: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: resolved = declared roots ∪ their closure, per project.

    Columns: project_id, ecosystem, name, version, dep_type, is_direct, depth, path.
    Direct packages have depth 0 and path ``[name]``; transitive ones carry
    version/dep_type ``transitive`` and the shortest path from any direct package.
    """
    resolved, closure = resolve_roots(dependencies, edges)
    return with_paths(written(resolved, "resolved-roots"), closure)


def depth_compat(dependencies: DataFrame, resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """The original tool's depth, next to the documented one.

    Its breadth-first pass starts from the direct packages in declaration
    order, so a direct package that is a child of an *earlier* declared direct
    package ends with depth 1; every other package keeps the fewest-hops depth.
    Columns: project_id, ecosystem, name, depth, depth_compat.
    """
    key = ["project_id", "ecosystem", "name"]
    # written: the edges' side and the children's side read the rows, they don't derive them twice
    nodes = written(declared_nodes(dependencies).select(*key, F.col("first_pos").alias("pos")), "positions")
    e = written(_edges(edges), "graph-edges")
    # a direct package is bumped if its first declared parent comes earlier
    first = dealt(
        nodes.withColumnRenamed("name", "parent").join(e.filter("parent != child"), ["ecosystem", "parent"])
        .select("project_id", "ecosystem", F.col("child").alias("name"), "pos"),
        *key,
    ).groupBy(*key).agg(F.min("pos").alias("first_parent"))
    later = (
        dealt(nodes, *key).join(first, key).filter("first_parent < pos")
        .select(*key, F.lit(True).alias("bumped"))
    )
    return dealt(resolved.select(*key, "depth"), *key).join(later, key, "left").select(
        *key, "depth", F.when(F.col("bumped"), F.lit(1)).otherwise(F.col("depth")).alias("depth_compat"),
    )


def shortest_paths(resolved: DataFrame) -> DataFrame:
    """project_id, ecosystem, name, path string ``a -> b -> c`` (length > 1 only)."""
    return resolved.filter(F.size("path") > 1).select(
        "project_id", "ecosystem", "name", F.array_join("path", " -> ").alias("dependency_path")
    )


def neighbours(edges: DataFrame, package: str, ecosystem: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(dependencies of ``package``, dependents of ``package``)."""
    e = _edges(edges)
    if ecosystem:
        e = e.filter(F.col("ecosystem") == ecosystem)
    p = package.lower()
    return (
        e.filter(F.col("parent") == p).select("ecosystem", F.col("child").alias("name")),
        e.filter(F.col("child") == p).select("ecosystem", F.col("parent").alias("name")),
    )


def add_edges(edges: DataFrame, extra: DataFrame) -> DataFrame:
    """Manual edges appended (set union)."""
    return _edges(edges.unionByName(extra.select("ecosystem", "parent", "child")))


def project_edges(resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges induced in each project: every known edge whose parent was reached."""
    e = written(_edges(edges), "graph-edges")  # planned with its real size, not that of the rows it comes from
    r = resolved.select("project_id", "ecosystem", F.col("name").alias("parent"))
    return r.join(e, ["ecosystem", "parent"]).select("project_id", "ecosystem", "parent", "child")


def graph_stats(resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """A9 + A7 per project: totals, max depth, most depended-on package (ties: smallest name), cycles.

    A project that reaches one package of a cycle reaches all of it, so its
    cycles are those whose first package it holds.
    """
    keys = ["project_id", "ecosystem"]  # edges are dealt out by them: what follows is grouped and joined in place
    base = resolved.groupBy(*keys).agg(
        F.count("*").alias("total_packages"),
        F.count_if(F.col("is_direct")).alias("direct_dependencies"),
        F.count_if(~F.col("is_direct")).alias("transitive_dependencies"),
        F.max("depth").alias("max_depth"),
    )
    pe = dealt(project_edges(resolved, edges), *keys)
    indeg = pe.groupBy("project_id", "ecosystem", "child").agg(F.countDistinct("parent").alias("n"))
    top = indeg.groupBy("project_id", "ecosystem").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("child").alias("c"))).alias("t")
    ).select("project_id", "ecosystem", F.col("t.c").alias("most_depended_on"), (-F.col("t.neg")).alias(
        "dependents_count"))
    heads = written(
        cycles(edges).groupBy("ecosystem", F.col("cycle")[0].alias("name")).agg(F.count("*").alias("n")), "cycle-heads")
    held = resolved.select("project_id", "ecosystem", "name").join(heads, ["ecosystem", "name"])
    loops = held.groupBy(*keys).agg(F.sum("n").alias("n_cycles"))
    return base.join(top, keys, "left").join(loops, keys, "left").select(
        "project_id", "ecosystem", "total_packages", "direct_dependencies", "transitive_dependencies",
        "max_depth", "most_depended_on", F.coalesce("dependents_count", F.lit(0)).alias("dependents_count"),
        F.coalesce("n_cycles", F.lit(0)).alias("circular_dependencies"),
    )


def children_counts(edges: DataFrame) -> DataFrame:
    """Number of distinct children per package."""
    return _edges(edges).groupBy("ecosystem", "parent").agg(F.countDistinct("child").alias("n_children"))


def blast_radius(resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (ecosystem, package): projects reaching it directly / transitively,
    and the number of distinct direct packages it is reached through.

    ``resolved`` with ``root`` or ``path``: a path begins with its root."""
    entry = F.col("root") if "root" in resolved.columns else F.col("path")[0]
    t = targets.select("ecosystem", F.lower("package").alias("name")).distinct()
    hit = resolved.join(t, ["ecosystem", "name"], "left_semi")
    return hit.groupBy("ecosystem", "name").agg(
        F.countDistinct("project_id").alias("n_projects"),
        F.count_if(F.col("is_direct")).alias("n_direct"),
        F.count_if(~F.col("is_direct")).alias("n_transitive"),
        F.countDistinct(F.when(~F.col("is_direct"), entry)).alias("n_entry_packages"),
    ).withColumnRenamed("name", "package")


def components(edges: DataFrame) -> DataFrame:
    """The strongly connected components that hold a cycle.

    Columns: ecosystem, component (its least name), size, member; one row per package on a cycle
    (a package with an edge to itself is a component of size 1).

    Forward/backward colouring: every package takes the greatest number of the packages that reach it,
    then each colour's own package walks back inside its colour, and what it meets is one component.
    Edges between colours or into a found component cannot lie on another cycle and go; the rest runs
    again.  Layers without in- or out-edges are trimmed before.  A round moves a component's edges once,
    never its pairs; packages are numbers (unique over all ecosystems) during the rounds.
    """
    e = _edges(edges)
    ends = e.select("ecosystem", F.col("parent").alias("name")).unionByName(e.select("ecosystem", F.col("child").alias("name")))
    nodes = written(ends.distinct().withColumn("id", F.monotonically_increasing_id()), "packages")
    loops = e.filter(F.col("parent") == F.col("child")).select("ecosystem", F.col("child").alias("name"))
    numbered = (
        e.filter(F.col("parent") != F.col("child"))
        .join(nodes.select("ecosystem", F.col("name").alias("parent"), F.col("id").alias("src")), ["ecosystem", "parent"])
        .join(nodes.select("ecosystem", F.col("name").alias("child"), F.col("id").alias("dst")), ["ecosystem", "child"])
        .select("src", "dst")
    )
    found = _strong(written(numbered, "numbered-edges"))
    named = loops.select("ecosystem", "name", F.lit(None).cast("long").alias("color"))
    for part in found:
        named = named.unionByName(part.join(nodes, "id").select("ecosystem", "name", "color"))
    # a package with an edge to itself may also lie in a larger component
    own = named.groupBy("ecosystem", "name").agg(F.max("color").alias("color"))
    group = F.when(F.col("color").isNull(), F.col("name")).otherwise(F.col("color").cast("string"))
    own = written(own.withColumn("is_loop", F.col("color").isNull()).withColumn("grp", group), "members")
    sizes = own.groupBy("ecosystem", "is_loop", "grp").agg(F.min("name").alias("component"), F.count("*").alias("size"))
    return own.join(sizes, ["ecosystem", "is_loop", "grp"]).select(
        "ecosystem", "component", "size", F.col("name").alias("member")
    )


def _strong(e: DataFrame) -> list[DataFrame]:
    """Tables (id, color) of the components with two or more packages; their color tells them apart."""
    found: list[DataFrame] = []
    e = _trimmed(e)
    while not e.isEmpty():
        color = _colored(e)
        src = color.select(F.col("id").alias("src"), F.col("color").alias("c"))
        dst = color.select(F.col("id").alias("dst"), F.col("color").alias("c"))
        inside = written(e.join(src, "src").join(dst, ["dst", "c"]).select("src", "dst"), "inside")
        # a color's own package has the greatest number in its color: who takes it backwards reaches it
        back = _colored(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        met = written(back.join(color, ["id", "color"]), "component")
        # a head alone in its component is on no cycle
        several = met.groupBy("color").agg(F.count("*").alias("n")).filter("n > 1")
        found.append(met.join(several, "color", "left_semi"))
        gone = met.select("id")
        rest = (
            inside.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
            .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        )
        e = _trimmed(rest)
    return found


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges whose source has an in-edge and whose target has an out-edge, as long as a layer takes a tenth or more."""
    e = written(e, "edges")
    n = e.count()
    while n:
        outs, ins = e.select(F.col("src").alias("dst")).distinct(), e.select(F.col("dst").alias("src")).distinct()
        e = written(e.join(outs, "dst", "left_semi").join(ins, "src", "left_semi"), "edges")
        before, n = n, e.count()
        if 10 * (before - n) < before:
            break
    return e


def _colored(e: DataFrame) -> DataFrame:
    """(id, color): the greatest id among a package and all that reach it.

    A round hands changed colors along the edges, then each package takes the color of its color (what
    reaches that reaches it, too), so long paths take few rounds.
    """
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    color = written(ends.select("id", F.col("id").alias("color"), F.lit(-1).cast("long").alias("old")), "colors")
    while True:
        changed = color.filter("color > old").select(F.col("id").alias("src"), "color")
        if changed.isEmpty():
            return color.select("id", "color")
        best = e.join(changed, "src").groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("best"))
        handed = written(
            color.join(best, "id", "left").select("id", F.greatest("color", "best").alias("color"), F.col("color").alias("old")), "handed"
        )
        heads = handed.select(F.col("id").alias("color"), F.col("color").alias("head"))
        color = written(handed.join(heads, "color").select("id", F.greatest("color", "head").alias("color"), "old"), "colors")


def _inner_edges(edges: DataFrame) -> DataFrame:
    """Edges that lie on a cycle: both ends in one component."""
    c = components(edges).select("ecosystem", "component", "member")
    return written(
        _edges(edges)
        .join(c.withColumnRenamed("member", "parent"), ["ecosystem", "parent"])
        .join(c.withColumnRenamed("member", "child"), ["ecosystem", "child", "component"])
        .select("ecosystem", "parent", "child"),
        "inner-edges",
    )


def cycles(edges: DataFrame) -> DataFrame:
    """G6 listing: one shortest cycle for every edge that lies on one, without a length limit.

    An edge lies on a cycle iff both ends are in one component; its cycle is the shortest path back inside
    the component closed by the edge, turned to start at its smallest node.  There are at most as many
    cycles as edges (all simple cycles can be exponentially many), and every package on a cycle is on one
    that is listed.  Columns: ecosystem, cycle (ARRAY, first node repeated at the end), length.
    """
    e = _inner_edges(edges)
    loops = e.filter(F.col("parent") == F.col("child")).select("ecosystem", F.array("parent").alias("nodes"))
    closed = _closing_paths(e)
    at = F.array_position("path", F.array_min("path")).cast("int")
    turned = closed.select("ecosystem", F.concat(
        F.slice("path", at, F.size("path")), F.slice("path", F.lit(1), at - 1)
    ).alias("nodes"))
    found = loops.unionByName(turned.distinct())
    return found.select("ecosystem", F.concat("nodes", F.array(F.col("nodes")[0])).alias("cycle"),
                        F.size("nodes").alias("length"))


def _closing_paths(e: DataFrame) -> DataFrame:
    """ecosystem, parent, child, path (child first, parent last) of the edges whose child reaches their parent."""
    e = e.filter(F.col("parent") != F.col("child"))
    reach = root_closure(e.select("ecosystem", F.col("child").alias("root")), e)
    return e.join(
        reach.select("ecosystem", F.col("root").alias("child"), F.col("node").alias("parent"), "path"),
        ["ecosystem", "parent", "child"],
    )


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """G6 membership: ecosystem, name of every package lying on some dependency cycle."""
    return components(edges).select("ecosystem", F.col("member").alias("name"))


def counted_chains(
    resolved: DataFrame, edges: DataFrame, targets: DataFrame, k: int = 3
) -> DataFrame:
    """G7 for asked packages: how many chains reach each, and the ``k`` best ones.

    ``targets``: (ecosystem, package).  Columns: project_id, ecosystem, name, n_chains (DECIMAL(38,0)), rank,
    chain (ARRAY, direct package first); chains are ranked by length, then by their names.  A direct
    package's only chain is itself.  Chains begin at a direct package and pass no other one.

    Chains grow one package a round from the direct packages down; a package's row carries the number of
    its chains of this length and the first ``k`` of them, so a round costs a project's edges, not its
    chains: the k best chains of a package extend k best chains of its parents.  Only packages from which
    a target can be reached take part.  Packages below a cycle have chains that must not meet themselves
    again; theirs are listed one by one (``dependency_chains``).
    """
    e = written(_edges(edges), "graph-edges")
    asked = targets.select("ecosystem", F.lower("package").alias("name")).distinct()
    upward = root_closure(
        asked.select("ecosystem", F.col("name").alias("root")),
        e.select("ecosystem", F.col("child").alias("parent"), F.col("parent").alias("child")),
    )
    useful = written(asked.unionByName(upward.select("ecosystem", F.col("node").alias("name"))).distinct(), "useful")
    rows = written(
        resolved.join(useful, ["ecosystem", "name"], "left_semi").select("project_id", "ecosystem", "name", "is_direct"), "rows"
    )
    ring = components(e).select("ecosystem", F.col("member").alias("root"))
    below = written(
        ring.select("ecosystem", F.col("root").alias("name"))
        .unionByName(root_closure(ring, e).select("ecosystem", F.col("node").alias("name"))).distinct(),
        "below-cycles",
    )
    key = ["project_id", "ecosystem"]
    free = rows.filter(~F.col("is_direct")).join(below, ["ecosystem", "name"], "left_anti")
    links = written(
        rows.withColumnRenamed("name", "parent").drop("is_direct").join(e, ["ecosystem", "parent"])
        .join(free.select(*key, F.col("name").alias("child")), [*key, "child"], "left_semi")
        .select(*key, "parent", "child"),
        "links",
    )
    level = written(
        rows.filter("is_direct").select(
            *key, "name", F.lit(1).cast("decimal(38,0)").alias("n"), F.array(F.array("name")).alias("chains")
        ),
        "chains",
    )
    levels = [level]
    while True:
        grown = level.withColumnRenamed("name", "parent").join(links, [*key, "parent"]).select(
            *key, F.col("child").alias("name"), "n",
            F.transform("chains", lambda c: F.concat(c, F.array("child"))).alias("chains"),
        )
        level = written(
            grown.groupBy(*key, "name").agg(
                F.sum("n").cast("decimal(38,0)").alias("n"),
                F.slice(F.array_sort(F.flatten(F.collect_list("chains"))), 1, k).alias("chains"),
            ),
            "chains",
        )
        if level.isEmpty():
            break
        levels.append(level)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    every = every.join(asked, ["ecosystem", "name"], "left_semi")
    # all that lies above an asked package is useful: their chains lie in ``rows``
    listed = dependency_chains(
        rows, e, rows.filter(~F.col("is_direct")).join(asked, ["ecosystem", "name"], "left_semi")
        .join(below, ["ecosystem", "name"], "left_semi"),
    )
    every = every.unionByName(
        listed.select(*key, "name", F.lit(1).cast("decimal(38,0)").alias("n"), F.array("chain").alias("chains"))
    )
    total = every.groupBy(*key, "name").agg(F.sum("n").cast("decimal(38,0)").alias("n_chains"))
    place = Window.partitionBy(*key, "name").orderBy("length", "chain")
    best = (
        every.select(*key, "name", F.explode("chains").alias("chain"))
        .withColumn("length", F.size("chain"))
        .withColumn("rank", F.row_number().over(place))
        .filter(F.col("rank") <= k)
    )
    return best.join(total, [*key, "name"]).select(*key, "name", "n_chains", "rank", "chain")


def dependency_chains(resolved: DataFrame, edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """G7 listing: every upward chain from each transitive package to the first direct package.

    There may be exponentially many; ``counted_chains`` counts them and gives the best.  ``starts``
    (project_id, ecosystem, name) restricts the listing to some packages.  Walks reverse edges inside each project's graph; a chain stops at a direct
    package, at a package without parents, or when every parent is already on
    the chain.  Columns: project_id, ecosystem, name, chain (ARRAY, direct end first).
    A chain never repeats a package, so the walk ends by itself (no length limit).
    """
    key = ["project_id", "ecosystem"]
    direct = resolved.filter("is_direct").select(*key, F.col("name").alias("p"), F.lit(True).alias("ends"))
    up = project_edges(resolved, edges).select(*key, F.col("child").alias("cur"), F.col("parent").alias("p"))
    up = written(up.join(direct, [*key, "p"], "left"), "parents")  # read by every round
    if starts is None:
        starts = resolved.filter(~F.col("is_direct"))
    open_ = starts.select(*key, "name", F.col("name").alias("cur"), F.array("name").alias("chain"))
    pieces: list[DataFrame] = []
    while True:
        # computed once a round, read by all that follows
        step = written(open_.join(up, [*key, "cur"], "left").drop("cur"), "step")
        fresh = F.col("p").isNotNull() & ~F.array_contains("chain", F.col("p"))
        # no parent, or every parent is on the chain already
        stuck = step.groupBy(*key, "name", "chain").agg(F.count_if(fresh).alias("n_new")).filter("n_new = 0")
        grown = step.filter(fresh).select(*key, "name", "p", "ends", F.concat("chain", F.array("p")).alias("chain"))
        pieces += [stuck.select(*key, "name", "chain"), grown.filter("ends").select(*key, "name", "chain")]
        open_ = grown.filter("ends IS NULL").select(*key, "name", F.col("p").alias("cur"), "chain")
        if open_.isEmpty():
            break
    done = pieces[0]
    for piece in pieces[1:]:
        done = done.unionByName(piece)
    return done.select(*key, "name", F.reverse("chain").alias("chain"))
