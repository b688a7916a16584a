"""Registered queries on what the main catalog's data does not reach, each with its DuckDB SQL.

Landed feeds written from the tables and read back (S9–S12, S14), built-in lookups (S13), popular
groups (S8, U3), scoped names (P4), repeated declarations (W1), rare version ranges (F9, J1), neighbours
and added edges (G3, G4), user patterns (X1), a plugged scanner with scans switched off (X2, P9), the
report's secret rows (P7) and alert streams with late and repeated rows, stopped and resumed (T3, T4).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetaudit.operators import confusion, licensing, outdated, report, textscan, vulnerability
from fleetaudit.plans import graph, oracle as O, scan
from fleetaudit.session import scratch_dir
from fleetaudit.sources import feeds, manifests
from fleetaudit.sources.testdata import TestData
from fleetaudit.streaming import arrivals


def _landed(df: DataFrame, name: str) -> str:
    """Write ``df`` as JSON lines, as a feed lands; its folder."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.json(path)
    return path


def _parts(td: TestData) -> DataFrame:
    return td.packages.select("p_partkey", "p_size", "p_retailprice", "ecosystem", "name")


# ------------------------------------------------------------------ landed feeds
def feed_advisories(spark, sf_dir):
    """One response per advisory; every second has a node without any field, too."""
    a = TestData(spark, sf_dir).advisories
    node = F.struct(
        F.struct(F.col("cve").alias("cveId"), "severity", "summary", "description").alias("advisory"),
        F.col("affected_versions").alias("vulnerableVersionRange"),
    )
    empty = F.lit(None).cast("struct<advisory: struct<cveId: string, severity: string, summary: string, description: string>, vulnerableVersionRange: string>")
    bare = F.struct(empty["advisory"].alias("advisory"), empty["vulnerableVersionRange"].alias("vulnerableVersionRange"))
    even = F.substring_index("cve", "-", -1).cast("bigint") % 2 == 0
    nodes = F.when(even, F.array(node, bare)).otherwise(F.array(node))
    response = F.struct(F.struct(F.struct(nodes.alias("nodes")).alias("securityVulnerabilities")).alias("data"))
    path = _landed(a.select("ecosystem", F.upper("package").alias("package"), response.alias("response")), "ghsa")
    return feeds.load_advisories(spark, path).select("ecosystem", "package", "cve", "severity", "affected_versions", "summary")


FEED_ADVISORIES = O.with_(O.PACKAGES, O.ADVISORIES) + """
SELECT ecosystem, package, cve, coalesce(severity, 'UNKNOWN') AS severity, affected_versions, coalesce(summary, '') AS summary
FROM advisories_t
UNION ALL
SELECT ecosystem, package, 'Unknown', 'UNKNOWN', '', '' FROM advisories_t
WHERE CAST(regexp_extract(cve, '([0-9]+)$', 1) AS BIGINT) % 2 = 0"""


def feed_nvd(spark, sf_dir):
    """Keyword responses without version ranges, severity missing in every third."""
    p = F.col("p_partkey")
    severity = F.when(p % 3 != 0, F.when(p % 2 == 0, "HIGH").otherwise("LOW"))
    item = F.struct(
        F.struct(
            F.struct(F.concat(F.lit("CVE-2020-"), p.cast("string")).alias("ID")).alias("CVE_data_meta"),
            F.struct(F.array(F.struct(F.concat(F.lit("Found in "), F.col("name")).alias("value"))).alias("description_data")).alias("description"),
        ).alias("cve"),
        F.struct(F.struct(F.struct(severity.alias("baseSeverity")).alias("cvssV3")).alias("baseMetricV3")).alias("impact"),
    )
    rows = _parts(TestData(spark, sf_dir)).filter(p % 7 == 1).select(
        "ecosystem", F.upper("name").alias("package"), F.struct(F.struct(F.array(item).alias("CVE_Items")).alias("result")).alias("response"))
    return feeds.load_nvd(spark, _landed(rows, "nvd")).select("ecosystem", "package", "cve", "severity", "affected_versions", "description")


FEED_NVD = O.with_(O.PACKAGES) + """
SELECT ecosystem, name AS package, 'CVE-2020-' || CAST(p_partkey AS VARCHAR) AS cve,
  CASE WHEN p_partkey % 3 = 0 THEN 'UNKNOWN' WHEN p_partkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity,
  CAST(NULL AS VARCHAR) AS affected_versions, 'Found in ' || name AS description
FROM packages WHERE p_partkey % 7 = 1"""

#: Licences that the landed registry bodies hold, by p_size % 7.
FEED_LICENSES_CYCLE = ["MIT", "Apache-2.0", "BSD-3-Clause", "GPL-3.0", "LGPL-2.1", "Proprietary Commercial", "EPL-2.0"]


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def feed_licenses(spark, sf_dir):
    """Registry bodies of all shapes: text, classifier, object, list, none."""
    p, eco = F.col("p_partkey"), F.col("ecosystem")
    lic = F.element_at(F.array(*map(F.lit, FEED_LICENSES_CYCLE)), (F.col("p_size") % 7 + 1).cast("int"))
    body = (
        F.when((eco == "python") & (p % 3 == 0), F.lit('{"info": {"license": "", "classifiers": ["Topic :: X", "License :: OSI Approved :: MIT License"]}}'))
        .when(eco == "python", _text('{"info": {"license": "', lic, '"}}'))
        .when((eco == "npm") & (p % 2 == 0), _text('{"license": {"type": "', lic, '"}}'))
        .when((eco == "npm") & (p % 5 == 0), _text('{"license": {"type": "', lic, '"}}'))
        .when(eco == "npm", _text('{"license": "', lic, '"}'))
        .when(eco == "ruby", _text('{"licenses": ["', lic, '", "Ruby"]}'))
        .otherwise(F.lit("{}"))
    )
    rows = _parts(TestData(spark, sf_dir)).select("ecosystem", F.upper("name").alias("package"), body.alias("body"))
    return feeds.load_licenses(spark, _landed(rows, "registry"))


FEED_LICENSES = O.with_(O.PACKAGES) + """
SELECT ecosystem, name AS package, CASE
    WHEN ecosystem = 'python' AND p_partkey % 3 = 0 THEN 'MIT License'
    WHEN ecosystem IN ('python', 'npm') THEN lic WHEN ecosystem = 'ruby' THEN lic || ', Ruby' ELSE 'Unknown' END AS license
FROM (SELECT *, ['MIT','Apache-2.0','BSD-3-Clause','GPL-3.0','LGPL-2.1','Proprietary Commercial','EPL-2.0'][p_size % 7 + 1] AS lic
      FROM packages)"""


def feed_latest(spark, sf_dir):
    """The registry's latest version by each registry's shape; missing in every tenth."""
    p, eco = F.col("p_partkey"), F.col("ecosystem")
    v = _text(((F.col("p_size") % 5).cast("string")), ".", (p % 7).cast("string"), ".1")
    body = (
        F.when(p % 10 == 0, F.lit("{}"))
        .when(eco == "python", _text('{"info": {"version": "', v, '"}}'))
        .when(eco == "maven", _text('{"response": {"docs": [{"latestVersion": "', v, '"}]}}'))
        .otherwise(_text('{"version": "', v, '"}'))
    )
    rows = _parts(TestData(spark, sf_dir)).select("ecosystem", F.upper("name").alias("package"), body.alias("body"))
    return feeds.load_latest(spark, _landed(rows, "registry"))


FEED_LATEST = O.with_(O.PACKAGES) + """
SELECT ecosystem, name AS package, CASE WHEN p_partkey % 10 = 0 THEN '0.0.0'
  ELSE CAST(p_size % 5 AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR) || '.1' END AS version
FROM packages"""


def snapshot_refresh(spark, sf_dir):
    """A snapshot of every second licence, then refreshed with all: held keys keep their value."""
    lic = TestData(spark, sf_dir).licenses
    path = f"{scratch_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    feeds.refresh_snapshot(spark, path, lic.filter(F.length("package") % 2 == 0))
    return feeds.refresh_snapshot(spark, path, lic.withColumn("license", F.concat(F.lit("fresh "), F.col("license"))))


SNAPSHOT_REFRESH = O.with_(O.PACKAGES, O.LICENSES) + """
SELECT ecosystem, package, CASE WHEN length(package) % 2 = 0 THEN license ELSE 'fresh ' || license END AS license FROM licenses_t"""


# ------------------------------------------------------------------ lookups, names, declarations
#: Names that only the built-in lookups know, and two that they don't.
LOOKUP_NAMES = ["requests", "Flask", "django", "flask", "React", "unknown-lib"]


def fallback_lookups(spark, sf_dir):
    """Advisories, licences and latest versions of packages for which no feed has landed anything."""
    p = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, LOOKUP_NAMES)), (p % 6 + 1).cast("int"))
    s = lambda c: c.cast("string")
    version = (
        F.when(p % 4 == 0, _text("2.", s(15 + p % 9), ".1")).when(p % 4 == 1, _text("3.2.", s(p % 13)))
        .when(p % 4 == 2, _text("1.1.", s(p % 5))).otherwise(F.lit("latest"))
    )
    deps = TestData(spark, sf_dir).table("part", ["p_partkey"]).select(
        p.alias("project_id"), F.lit("python").alias("ecosystem"), name.alias("name"), version.alias("version"))
    none = lambda schema: spark.createDataFrame([], schema)
    key = "ecosystem string, package string, "
    adv = vulnerability.with_fallback_advisories(
        none(key + "cve string, severity string, affected_versions string, summary string, description string"))
    found = [
        vulnerability.vulnerability_alerts(deps, adv).select(F.lit("advisory").alias("kind"), "project_id", "package", F.concat_ws(" ", "cve", "severity").alias("detail")),
        licensing.license_inventory(deps, none(key + "license string")).select(F.lit("licence").alias("kind"), "project_id", "package", F.concat_ws(" ", "license", "risk").alias("detail")),
        outdated.outdated_alerts(deps, none(key + "version string")).select(F.lit("latest").alias("kind"), "project_id", "package", F.concat_ws(" ", "installed_version", "latest_version").alias("detail")),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


FALLBACK_LOOKUPS = f"""
WITH deps AS (
  SELECT p_partkey AS project_id, ['requests','Flask','django','flask','React','unknown-lib'][p_partkey % 6 + 1] AS package,
    CASE p_partkey % 4 WHEN 0 THEN '2.' || CAST(15 + p_partkey % 9 AS VARCHAR) || '.1' WHEN 1 THEN '3.2.' || CAST(p_partkey % 13 AS VARCHAR)
      WHEN 2 THEN '1.1.' || CAST(p_partkey % 5 AS VARCHAR) ELSE 'latest' END AS v
  FROM part),
adv(name, cve, range, severity) AS (VALUES
  ('django', 'CVE-2022-28346', '<3.2.13,>=3.2,<3.1.14,>=3.1,<4.0.7,>=4.0', 'HIGH'), ('django', 'CVE-2021-35042', '<3.2.9', 'MEDIUM'),
  ('requests', 'CVE-2018-18074', '<2.20.0', 'MEDIUM'), ('flask', 'CVE-2021-29492', '<1.1.2', 'MEDIUM')),
lic(name, license) AS (VALUES ('requests', 'Apache-2.0'), ('flask', 'BSD-3-Clause'), ('django', 'BSD-3-Clause'), ('react', 'MIT')),
latest(name, latest) AS (VALUES ('requests', '2.32.3'), ('flask', '3.0.3'), ('django', '5.0.6'), ('react', '18.3.1'))
SELECT 'advisory' AS kind, project_id, package, cve || ' ' || severity AS detail
FROM deps JOIN adv ON name = package WHERE {O.in_range_sql('v', 'range')}
UNION ALL
SELECT 'licence', project_id, package, coalesce(license || ' LOW', 'Unknown MEDIUM') FROM deps LEFT JOIN lic ON name = lower(package)
UNION ALL
SELECT 'latest', project_id, package, v || ' ' || latest FROM deps JOIN latest ON name = lower(package)
WHERE v <> 'latest' AND {O.vk('v')} < {O.vk('latest')}"""


def popular_groups(spark, sf_dir):
    """Popular names given in groups, with the shared group and upper-case letters."""
    p = F.col("p_partkey")
    group = F.when(p % 3 == 0, "python").when(p % 3 == 1, "npm").otherwise("shared")
    return feeds.popular_from_groups(TestData(spark, sf_dir).packages.select(group.alias("group"), F.upper("base").alias("name")))


POPULAR_GROUPS = O.with_(O.PACKAGES) + """
SELECT DISTINCT e.ecosystem, base AS name FROM packages, (SELECT unnest(['python','npm','ruby','maven']) AS ecosystem) e
WHERE e.ecosystem IN ('ruby', 'maven') OR p_partkey % 3 = 2 OR (e.ecosystem = 'python' AND p_partkey % 3 = 0)
  OR (e.ecosystem = 'npm' AND p_partkey % 3 = 1)"""


def scoped_unregistered(spark, sf_dir):
    """Scoped names (``@corp/...``), of which every second is registered; a scope counts in any ecosystem."""
    td = TestData(spark, sf_dir)
    scoped = ((F.col("ecosystem") == "npm") & (F.col("pos") % 3 == 0)) | ((F.col("ecosystem") == "maven") & (F.col("pos") % 5 == 0))
    deps = td.declared.withColumn("name", F.when(scoped, F.concat(F.lit("@corp/"), F.col("name"))).otherwise(F.col("name")))
    known = td.registry_names.unionByName(
        td.packages.filter(F.length("name") % 2 == 0).select("ecosystem", F.concat(F.lit("@corp/"), F.col("name")).alias("package")).distinct())
    return confusion.unregistered_alerts(deps, known).select("project_id", "ecosystem", "package", "severity", "message")


SCOPED_UNREGISTERED = O.with_(*O.BASE, O.REGISTRY, """
said AS (
  SELECT project_id, ecosystem, CASE WHEN (ecosystem = 'npm' AND pos % 3 = 0) OR (ecosystem = 'maven' AND pos % 5 = 0)
    THEN '@corp/' || name ELSE name END AS package FROM deps)""") + """
SELECT project_id, ecosystem, package, 'CRITICAL' AS severity,
  CASE WHEN package LIKE '@%' THEN 'Private scoped package ''' ELSE 'Private dependency ''' END || package
  || ''' is NOT registered on the public registry.' AS message
FROM said d
WHERE (package LIKE '@%' OR ecosystem <> 'maven')
  AND NOT EXISTS (SELECT 1 FROM registry_t g WHERE g.ecosystem = d.ecosystem AND g.package = d.package)
  AND NOT EXISTS (SELECT 1 FROM packages k WHERE k.ecosystem = d.ecosystem AND length(k.name) % 2 = 0 AND '@corp/' || k.name = d.package)"""


def redeclared(spark, sf_dir):
    """Packages declared twice and installed: which version, type and position stay."""
    d = TestData(spark, sf_dir).declared
    again = d.filter(F.length("name") % 2 == 0).withColumns({
        "version": F.concat(F.lit("9."), F.col("pos").cast("string")), "dep_type": F.lit("again"), "pos": F.col("pos") + 100,
        "name": F.upper("name"),
    })
    installed = d.filter(F.length("name") % 3 == 0).withColumns({
        "version": F.lit("transitive"), "dep_type": F.lit("transitive"), "source": F.lit("installed"), "pos": F.lit(None).cast("int"),
    })
    return graph.declared_nodes(d.unionByName(again).unionByName(installed)).select(
        "project_id", "ecosystem", "name", "version", "dep_type", "first_pos", "n_declarations")


REDECLARED = O.with_(*O.BASE) + """
SELECT project_id, ecosystem, name, CASE WHEN length(name) % 2 = 0 THEN '9.' || CAST(pos AS VARCHAR) ELSE version END AS version,
  CASE WHEN length(name) % 3 = 0 THEN 'transitive' WHEN length(name) % 2 = 0 THEN 'again' ELSE coalesce(dep_type, 'direct') END AS dep_type,
  pos AS first_pos, CAST(1 + (CASE WHEN length(name) % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN length(name) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_declarations
FROM deps"""


# ------------------------------------------------------------------ rare version ranges
#: Endings of versions (by p_partkey % 8) and of ranges (by p_partkey % 11); a, b, c are the release numbers.
RARE_VERSIONS = ["{a}.{b}.{c}", "{a}.{b}.{c}", "{a}.{b}.{c}rc1", "{a}.{b}.{c}.post2", "{a}.{b}.{c}.dev3", "{a}.{b}.{c}a1", "{a}.{b}.{c}+abc.5",
                 "{a}.{b}.{c}.post1.dev4"]
RARE_RANGES = ["~={a}.{b}", "!={a}.{b}.{c}", "==={a}.{b}.{c}rc1", "<{a}.{b}.{c}.post1", ">{a}.{b}.{c}", ">={a}.{b}.{c}.dev2",
               "<={a}.{b}.{c}rc1", "=={a}.{b}.*", "~={a}.{b}.{c}", "!={a}.*,>=0.1", ">{a}.{b}.{c}.post1"]


def rare_ranges(spark, sf_dir):
    """Which versions lie in which ranges, with ``~=``, ``!=``, ``===``, pre, post, dev and local parts.

    Forty parts make a package: each gives a version and a range.
    """
    parts = TestData(spark, sf_dir).table("part", ["p_partkey", "p_size", "p_retailprice"])
    numbers = {"a": "p_size % 3", "b": "p_partkey % 4", "c": "CAST(floor(p_retailprice) AS BIGINT) % 3"}

    def filled(forms: list[str]) -> str:
        cases = " ".join(
            f"WHEN {i} THEN '" + form.replace("{a}", f"' || {numbers['a']} || '").replace("{b}", f"' || {numbers['b']} || '").replace("{c}", f"' || {numbers['c']} || '") + "'"
            for i, form in enumerate(forms)
        )
        return f"CASE p_partkey % {len(forms)} {cases} END"

    family = "CAST(p_partkey div 40 AS STRING) AS package"
    versions = parts.selectExpr("'python' AS ecosystem", family, f"{filled(RARE_VERSIONS)} AS version")
    ranges = parts.selectExpr("'python' AS ecosystem", family, f"{filled(RARE_RANGES)} AS affected_versions")
    return vulnerability.matching_ranges(versions, ranges)


def _key(r: str, pre_rank: int, pre: int, post: int, dev: int) -> str:
    return "{'r': " + r + f", 'k': [{pre_rank}, {pre}, {post}, {dev}]" + "}"


def _rare_sql() -> str:
    most = 999
    release = "CASE WHEN {p}c <> 0 THEN [{p}a, {p}b, {p}c] WHEN {p}b <> 0 THEN [{p}a, {p}b] ELSE [{p}a] END"
    v, s = release.format(p=""), release.format(p="")
    ends = {2: (2, 1, -1, most), 3: (3, 0, 2, most), 4: (-1, 0, -1, 3), 5: (0, 1, -1, most), 7: (3, 0, 1, 4)}
    key = "CASE n " + " ".join(f"WHEN {n} THEN {_key(v, *e)}" for n, e in ends.items()) + f" ELSE {_key(v, 3, 0, -1, most)} END"
    text = "CASE n " + " ".join(
        f"WHEN {i} THEN '" + form.replace("{a}", "' || a || '").replace("{b}", "' || b || '").replace("{c}", "' || c || '") + "'"
        for i, form in enumerate(RARE_VERSIONS)) + " END"
    said = "CASE n " + " ".join(
        f"WHEN {i} THEN '" + form.replace("{a}", "' || a || '").replace("{b}", "' || b || '").replace("{c}", "' || c || '") + "'"
        for i, form in enumerate(RARE_RANGES)) + " END"
    short = "CASE WHEN b <> 0 THEN [a, b] ELSE [a] END"
    asked = (
        f"CASE n WHEN 0 THEN {_key(short, 3, 0, -1, most)} WHEN 3 THEN {_key(s, 3, 0, 1, most)} WHEN 5 THEN {_key(s, -1, 0, -1, 2)}"
        f" WHEN 6 THEN {_key(s, 2, 1, -1, most)} WHEN 9 THEN {_key('[0, 1]', 3, 0, -1, most)} WHEN 10 THEN {_key(s, 3, 0, 1, most)}"
        f" ELSE {_key(s, 3, 0, -1, most)} END"
    )
    parts = ("SELECT CAST(p_partkey // 40 AS VARCHAR) AS package, p_partkey % {n} AS n, CAST(p_size % 3 AS BIGINT) AS a, p_partkey % 4 AS b, "
             "CAST(floor(p_retailprice) AS BIGINT) % 3 AS c FROM part")
    return f"""
WITH v AS (SELECT package, n, a, b, c, {text} AS version, {key} AS k, {v} AS r FROM ({parts.format(n=8)})),
s AS (SELECT package, n AS kind, a AS sa, b AS sb, {said} AS affected_versions, {asked} AS sk, {s} AS sr FROM ({parts.format(n=11)}))
SELECT DISTINCT 'python' AS ecosystem, v.package, version, affected_versions
FROM v JOIN s ON s.package = v.package
WHERE (n NOT IN (2, 4, 5, 7) OR kind IN (2, 5, 6)) AND CASE kind
  WHEN 0 THEN k >= sk AND a = sa WHEN 1 THEN k <> sk WHEN 2 THEN '===' || version = affected_versions
  WHEN 3 THEN k < sk AND NOT (n IN (2, 4, 5, 7) AND r = sr) WHEN 4 THEN k > sk AND NOT (n IN (3, 6, 7) AND r = sr)
  WHEN 5 THEN k >= sk WHEN 6 THEN k <= sk WHEN 7 THEN a = sa AND b = sb WHEN 8 THEN k >= sk AND a = sa AND b = sb
  WHEN 9 THEN a <> sa AND k >= sk ELSE k > sk AND NOT (n = 6 AND r = sr) END"""


# ------------------------------------------------------------------ graph, patterns, scanners
def neighbours(spark, sf_dir):
    """What internal-32 depends on and what depends on it, with edges added by hand."""
    td = TestData(spark, sf_dir)
    extra = td.packages.filter("p_partkey % 64 = 28").select("ecosystem", F.upper("name").alias("parent"), F.lit("Internal-32").alias("child"))
    down, up = graph.neighbours(graph.add_edges(td.edges, extra), "Internal-32", "python")
    return down.withColumn("side", F.lit("dependency")).unionByName(up.withColumn("side", F.lit("dependent")))


NEIGHBOURS = O.with_(O.PACKAGES, O.EDGES, """
grown AS (SELECT * FROM edges UNION SELECT ecosystem, name, 'internal-32' FROM packages WHERE p_partkey % 64 = 28)""") + """
SELECT ecosystem, child AS name, 'dependency' AS side FROM grown WHERE parent = 'internal-32' AND ecosystem = 'python'
UNION ALL SELECT ecosystem, parent, 'dependent' FROM grown WHERE child = 'internal-32' AND ecosystem = 'python'"""


def user_patterns(spark, sf_dir):
    """A user's pattern beside the built-in ones: alerts per pattern and severity."""
    extra = [textscan.Pattern("MAKE_TEST", r"make\s+test", "Runs the tests", "LOW")]
    found = textscan.pipeline_alerts(TestData(spark, sf_dir).pipeline_files, extra)
    return found.groupBy("pattern_name", "severity").agg(F.count("*").alias("n"))


def plugged_scanner(spark, sf_dir):
    """A plugged scanner (unpinned versions) chosen alone; licences, confusion and staleness run always."""
    td = TestData(spark, sf_dir)
    t = scan.ScanInputs(
        dependencies=td.declared, edges=td.edges, popular=td.popular, advisories=td.advisories, licenses=td.licenses,
        releases=td.releases, registry_names=td.registry_names, config_files=td.config_files)
    scan.register_scanner("unpinned", "artifacts", lambda t: t.dependencies.filter("version = 'latest'").select(
        "project_id", "ecosystem", F.lit("UNPINNED").alias("type"), F.col("name").alias("package"), F.lit("LOW").alias("severity")))
    try:
        raw = scan.raw_alerts(t, ["unpinned"])
    finally:
        del scan.SCANNERS["unpinned"]
    return report.project_summary(t.dependencies, raw).select(
        "project_id", "vulnerabilities_found", "typosquatting_alerts", "licenses_found", "dep_confusion_issues", "versions_outdated",
        "artifact_issues", "total_issues")


def secret_report(spark, sf_dir):
    """The report's columns of secrets in files and in history."""
    td = TestData(spark, sf_dir)
    found = textscan.secret_alerts(td.source_files).unionByName(textscan.history_secret_alerts(td.diff_lines), allowMissingColumns=True)
    return textscan.secret_projection(found).select("project_id", "type", "file", "severity", "line", "commit")


def pom_forms(spark, sf_dir):
    """The same pom files with CDATA sections, character references or prefixed tags, and comments."""
    m = TestData(spark, sf_dir).manifests.filter("ecosystem = 'maven'")
    c, k = F.col("content"), F.col("project_id") % 3
    cdata = F.regexp_replace(c, r"<(groupId|version)>([^<]*)</", "<$1><![CDATA[$2]]></")
    numbers = F.regexp_replace(F.regexp_replace(c, r"<version>([0-9]+)[.]", "<version>$1&#46;"), r"<groupId>org[.]", "<groupId>org&#x2E;")
    prefixed = F.regexp_replace(F.regexp_replace(c, r"<(/?)([A-Za-z])", "<$1m:$2"), "xmlns=", "xmlns:m=")
    form = F.when(k == 0, cdata).when(k == 1, numbers).otherwise(prefixed)
    said = F.concat(form, F.lit("<!-- <dependency><groupId>a</groupId><artifactId>b</artifactId></dependency> -->"))
    return manifests.pom_deps(m.withColumn("content", said)).select(
        "project_id", "ecosystem", "pos", "name", "version", "dep_type", "scope", "is_dev", "is_optional")


# ------------------------------------------------------------------ streams
def _arrivals(spark, sf_dir) -> list[DataFrame]:
    """``events`` in five arrivals: eight days each, one event in 11 an arrival late, one in 13 again an arrival later."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    turn = F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8))
    first = events.withColumn("arrival", turn + (F.col("event_id") % 11 == 3).cast("int"))
    again = events.where("event_id % 13 = 5").withColumn("arrival", turn + 1)
    every = first.unionByName(again)
    return [every.where(F.col("arrival") == k).drop("arrival") for k in range(5)]


def _streamed(spark, sf_dir, job) -> DataFrame:
    """``job`` over three arrivals, stopped, and resumed after the other two."""
    landing, out = arrivals.scratch_dir(spark, "arrivals"), arrivals.scratch_dir(spark, "resumed")
    for k, arrival in enumerate(_arrivals(spark, sf_dir)):
        arrivals.land_events(spark, arrival, landing)
        if k == 2:
            job(spark, landing, out)
    return job(spark, landing, out)


def stream_late_windows(spark, sf_dir):
    """Sliding windows, late events apart."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    out = _streamed(spark, sf_dir, arrivals.sliding_alert_counts)
    return out.select(text("window_start"), text("window_end"), "category", "n_alerts", "n_late")


def stream_idle_projects(spark, sf_dir):
    """T4: closed episodes of projects."""
    out = _streamed(spark, sf_dir, arrivals.project_episodes)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("project_id", text("first_ts"), text("last_ts"), *arrivals.COUNTS, "security_score", "band")


_ARRIVED = """
WITH ev AS (
  SELECT event_id, ts, user_id AS project_id, CAST(floor((day(ts) - 1) / 8) AS INTEGER) AS eighth,
    CASE event_type WHEN 'error' THEN 'vulnerabilities' WHEN 'signup' THEN 'dep_confusion'
      WHEN 'click' THEN 'typosquatting' WHEN 'view' THEN 'pipeline' WHEN 'purchase' THEN 'versions' END AS category,
    CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'signup' THEN 'CRITICAL' WHEN 'purchase' THEN 'LOW' ELSE 'MEDIUM' END AS severity
  FROM events),
arr AS (
  SELECT *, least(3, eighth) + CASE WHEN event_id % 11 = 3 THEN 1 ELSE 0 END AS arrival FROM ev
  UNION ALL SELECT *, least(3, eighth) + 1 FROM ev WHERE event_id % 13 = 5),
seen AS (SELECT k.arrival, max(a.ts) AS newest FROM (SELECT DISTINCT arrival FROM arr) k JOIN arr a ON a.arrival < k.arrival GROUP BY 1),
judged AS (
  SELECT a.event_id, a.ts, a.project_id, a.category, a.severity, coalesce(a.ts < s.newest - INTERVAL 1 HOUR, false) AS late
  FROM arr a LEFT JOIN seen s ON s.arrival = a.arrival),
once AS (SELECT event_id, ts, project_id, category, severity, bool_and(late) AS late FROM judged GROUP BY ALL)"""

STREAM_LATE_WINDOWS = _ARRIVED + """,
slid AS (
  SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) AS w FROM once
  UNION ALL SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE FROM once)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, category,
  CAST(count_if(NOT late) AS BIGINT) AS n_alerts, CAST(count_if(late) AS BIGINT) AS n_late
FROM slid GROUP BY ALL"""

STREAM_IDLE_PROJECTS = _ARRIVED + """,
gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER p < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens
  FROM once WHERE NOT late WINDOW p AS (PARTITION BY project_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS episode FROM gaps),
closed AS (
  SELECT project_id, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count_if(severity = 'CRITICAL') AS BIGINT) AS n_critical,
    CAST(count_if(severity = 'HIGH') AS BIGINT) AS n_high, CAST(count_if(severity = 'MEDIUM') AS BIGINT) AS n_medium,
    CAST(count_if(severity = 'LOW') AS BIGINT) AS n_low
  FROM numbered GROUP BY project_id, episode
  HAVING max(ts) + INTERVAL 12 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM judged WHERE NOT late)),
scored AS (SELECT *, CAST(greatest(0, 100 - 15 * n_critical - 8 * n_high - 3 * n_medium - n_low) AS INTEGER) AS security_score FROM closed)
SELECT project_id, strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(last_ts, '%Y-%m-%d %H:%M:%S.%f') AS last_ts,
  n_critical, n_high, n_medium, n_low, security_score,
  CASE WHEN security_score >= 80 THEN 'SECURE' WHEN security_score >= 50 THEN 'WARNING' ELSE 'VULNERABLE' END AS band
FROM scored"""


QUERIES = {
    "pom_forms": pom_forms,
    "feed_advisories": feed_advisories,
    "feed_nvd": feed_nvd,
    "feed_licenses": feed_licenses,
    "feed_latest": feed_latest,
    "snapshot_refresh": snapshot_refresh,
    "fallback_lookups": fallback_lookups,
    "popular_groups": popular_groups,
    "scoped_unregistered": scoped_unregistered,
    "redeclared": redeclared,
    "rare_ranges": rare_ranges,
    "neighbours": neighbours,
    "user_patterns": user_patterns,
    "plugged_scanner": plugged_scanner,
    "secret_report": secret_report,
    "stream_late_windows": stream_late_windows,
    "stream_idle_projects": stream_idle_projects,
}


def sql() -> dict[str, str]:
    return {
        "pom_forms": O.with_(*O.BASE)
        + "\nSELECT project_id, ecosystem, pos, name, version, dep_type, scope, is_dev, is_optional FROM deps WHERE ecosystem = 'maven'",
        "feed_advisories": FEED_ADVISORIES,
        "feed_nvd": FEED_NVD,
        "feed_licenses": FEED_LICENSES,
        "feed_latest": FEED_LATEST,
        "snapshot_refresh": SNAPSHOT_REFRESH,
        "fallback_lookups": FALLBACK_LOOKUPS,
        "popular_groups": POPULAR_GROUPS,
        "scoped_unregistered": SCOPED_UNREGISTERED,
        "redeclared": REDECLARED,
        "rare_ranges": _rare_sql(),
        "neighbours": NEIGHBOURS,
        "stream_late_windows": STREAM_LATE_WINDOWS,
        "stream_idle_projects": STREAM_IDLE_PROJECTS,
        "user_patterns": f"""
SELECT pattern_name, severity, count(*) AS n FROM ({O.pipeline_sql()}) GROUP BY ALL
UNION ALL
SELECT 'MAKE_TEST', 'LOW', count(*) FROM ({O.with_(O.PACKAGES, O.PIPELINE_FILES)}
  SELECT * FROM pipe_files WHERE content LIKE '%make test%' AND path NOT LIKE 'docs/%')""",
        "plugged_scanner": O.with_(*O.all_alerts_ctes(), recursive=True) + """,
kept AS (
  SELECT project_id, category FROM alerts WHERE category IN ('licenses', 'dep_confusion', 'versions')
  UNION ALL SELECT project_id, 'artifacts' FROM deps WHERE version = 'latest'
  UNION ALL SELECT project_id, NULL FROM deps)
SELECT project_id, CAST(0 AS BIGINT) AS vulnerabilities_found, CAST(0 AS BIGINT) AS typosquatting_alerts,
  count(CASE WHEN category = 'licenses' THEN 1 END) AS licenses_found, count(CASE WHEN category = 'dep_confusion' THEN 1 END) AS dep_confusion_issues,
  count(CASE WHEN category = 'versions' THEN 1 END) AS versions_outdated, count(CASE WHEN category = 'artifacts' THEN 1 END) AS artifact_issues,
  count(category) AS total_issues
FROM kept GROUP BY project_id""",
        "secret_report": f"""
SELECT project_id, type, file, severity, line, NULL AS commit FROM ({O.secrets_sql()})
UNION ALL SELECT project_id, type, file, severity, line, commit FROM ({O.history_sql()})""",
    }
