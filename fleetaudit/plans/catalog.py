"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's parquet tables through ``TestData`` (derived
dependency tables) and runs the library operators over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetaudit.operators import confusion, licensing, outdated, textscan, typosquat, vulnerability
from fleetaudit.plans import graph, listing, scan
from fleetaudit.session import written
from fleetaudit.sources import manifests as M
from fleetaudit.sources.testdata import TestData
from fleetaudit.streaming import alerts as stream

DEP_OUT = ["project_id", "ecosystem", "pos", "name", "version", "dep_type", "scope", "is_dev", "is_optional"]


def _td(spark: SparkSession, sf_dir: str) -> TestData:
    return TestData(spark, sf_dir)


def _roots(td: TestData) -> DataFrame:
    """The resolved packages without paths, computed once and written."""
    return written(graph.resolve_roots(td.declared, td.edges)[0], "resolved")


def _resolved(td: TestData) -> DataFrame:
    """The resolved packages with paths, computed once and written."""
    return written(graph.resolve(td.declared, td.edges), "resolved")


# ------------------------------------------------------------------ parsers
def _parse(eco: str, fn) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        td = _td(spark, sf_dir)
        return fn(td.manifests.filter(F.col("ecosystem") == eco)).select(*DEP_OUT)

    q.__name__ = f"parse_{eco}"
    return q


def manifest_dispatch(spark, sf_dir):
    """S6 + all parsers: per manifest, the ecosystem chosen from the path and the rows parsed."""
    td = _td(spark, sf_dir)
    deps, _ = M.parse_manifests(td.manifests.drop("ecosystem"))
    return deps.groupBy("project_id", "path", "ecosystem").agg(F.count("*").alias("n_deps"))


def quarantined_manifests(spark, sf_dir):
    """All manifests, those of every seventh project cut off in the middle."""
    half = F.expr("left(content, cast(length(content) / 2 as int))")
    m = _td(spark, sf_dir).manifests
    m = m.withColumn("content", F.when(F.col("project_id") % 7 == 0, half).otherwise(F.col("content")))
    return M.quarantined(m)


def installed_npm(spark, sf_dir):
    """S3 + U2: installed packages found in node_modules, appended to npm projects."""
    td = _td(spark, sf_dir)
    npm = td.manifests.filter(F.col("ecosystem") == "npm").drop("ecosystem")
    deps, _ = M.parse_manifests(npm, td.installed_files)
    return deps.filter(F.col("source") == "installed").select("project_id", "name", "version", "dep_type")


# ------------------------------------------------------------------ graph
def closure_depth(spark, sf_dir):
    r = _resolved(_td(spark, sf_dir))
    return r.select("project_id", "ecosystem", "name", "version", "is_direct", "depth")


def depth_compat(spark, sf_dir):
    td = _td(spark, sf_dir)
    return graph.depth_compat(td.declared, _roots(td), td.edges)


def shortest_path(spark, sf_dir):
    return graph.shortest_paths(_resolved(_td(spark, sf_dir)))


def graph_stats(spark, sf_dir):
    td = _td(spark, sf_dir)
    return graph.graph_stats(_roots(td), td.edges)


def blast_radius(spark, sf_dir):
    td = _td(spark, sf_dir)
    return graph.blast_radius(_roots(td), td.advisories.select("ecosystem", "package"))


def children_counts(spark, sf_dir):
    return graph.children_counts(_td(spark, sf_dir).edges)


def last_declaration(spark, sf_dir):
    return graph.declared_nodes(_td(spark, sf_dir).declared).select(
        "project_id", "ecosystem", "name", "version", "dep_type", "first_pos", "n_declarations"
    )


def declared_count(spark, sf_dir):
    td = _td(spark, sf_dir)
    return td.declared.groupBy("project_id").agg(F.count("*").alias("total_dependencies"))


# ------------------------------------------------------------------ vulnerabilities / versions
def vulnerable_deps(spark, sf_dir):
    td = _td(spark, sf_dir)
    adv = vulnerability.with_fallback_advisories(td.advisories)
    return vulnerability.vulnerability_alerts(_roots(td), adv).select(
        "project_id", "ecosystem", "package", "version", "cve", "severity", "message"
    )


def latest_release(spark, sf_dir):
    return outdated.latest_release(_td(spark, sf_dir).releases)


def outdated_deps(spark, sf_dir):
    td = _td(spark, sf_dir)
    return outdated.outdated_alerts(td.declared, td.releases).select(
        "project_id", "ecosystem", "package", "installed_version", "latest_version", "message"
    )


# ------------------------------------------------------------------ typosquatting
def _typo_names(td: TestData) -> DataFrame:
    return td.declared.select("ecosystem", "name")


def typo_candidates(spark, sf_dir):
    td = _td(spark, sf_dir)
    return typosquat.typosquat_candidates(_typo_names(td), td.popular).select(
        "ecosystem", "name", "similar_to", "technique", "confidence", "severity"
    )


def _typo_technique(*techniques: str):
    def q(spark, sf_dir):
        return typo_candidates(spark, sf_dir).filter(F.col("technique").isin(*techniques))

    return q


def typosquat_alerts(spark, sf_dir):
    td = _td(spark, sf_dir)
    return typosquat.typosquat_alerts(_roots(td), td.popular).select(
        "project_id", "ecosystem", "package", "similar_to", "technique", "severity", "message"
    )


# ------------------------------------------------------------------ licences
def license_inventory(spark, sf_dir):
    td = _td(spark, sf_dir)
    return licensing.license_inventory(_roots(td), td.licenses)


def license_alerts(spark, sf_dir):
    td = _td(spark, sf_dir)
    return licensing.license_alerts(_roots(td), td.licenses).select(
        "project_id", "ecosystem", "type", "package", "license", "severity", "message"
    )


def license_risk_docs(spark, sf_dir):
    """F10 on real text: licence sentences found in documents, by risk."""
    td = _td(spark, sf_dir)
    lines = textscan.file_lines(td.source_files)
    lic = lines.filter(F.col("text").rlike(r"(?i)licen[sc]e")).select(
        "project_id", "path", "line", F.col("text").alias("license")
    )
    r = licensing.license_risk(F.col("license"))
    return lic.select("project_id", "path", "line", r["risk"].alias("risk"), r["description"].alias("description"))


# ------------------------------------------------------------------ dependency confusion
def unregistered_deps(spark, sf_dir):
    td = _td(spark, sf_dir)
    return confusion.unregistered_alerts(td.declared, td.registry_names).select(
        "project_id", "ecosystem", "package", "severity", "message"
    )


def npm_config_alerts(spark, sf_dir):
    return confusion.npm_config_alerts(_td(spark, sf_dir).config_files).select(
        "project_id", "file", "severity", "message"
    )


def pip_config_alerts(spark, sf_dir):
    return confusion.pip_config_alerts(_td(spark, sf_dir).config_files).select(
        "project_id", "file", "severity", "message"
    )


# ------------------------------------------------------------------ text scans
def pipeline_alerts(spark, sf_dir):
    return textscan.pipeline_alerts(_td(spark, sf_dir).pipeline_files).select(
        "project_id", "file", "line", "pattern_name", "severity", "description"
    )


def secret_alerts(spark, sf_dir):
    return textscan.secret_alerts(_td(spark, sf_dir).source_files).select(
        "project_id", "type", "file", "line", "severity"
    )


def history_secrets(spark, sf_dir):
    return textscan.history_secret_alerts(_td(spark, sf_dir).diff_lines).select(
        "project_id", "type", "commit", "file", "line", "severity"
    )


# ------------------------------------------------------------------ report
def scan_inputs(td: TestData) -> scan.ScanInputs:
    return scan.ScanInputs(
        dependencies=td.declared, edges=td.edges, popular=td.popular, advisories=td.advisories,
        licenses=td.licenses, releases=td.releases, registry_names=td.registry_names,
        config_files=td.config_files, pipeline_files=td.pipeline_files, source_files=td.source_files,
        diff_lines=td.diff_lines,
    )


def full_scan(td: TestData) -> tuple[DataFrame, DataFrame]:
    """The full scan of every project, all seven scanners: (enriched alerts, project summary)."""
    return scan.scan_projects(scan_inputs(td), list(scan.SCANNERS))


def full_summary(td: TestData) -> DataFrame:
    return scan.summarise(scan_inputs(td), list(scan.SCANNERS))


def enriched_alerts(spark, sf_dir):
    alerts, _ = full_scan(_td(spark, sf_dir))
    return alerts.select("project_id", "category", "type", "package", "severity", "is_transitive",
                         "dependency_path", "message")


def project_summary(spark, sf_dir):
    s = full_summary(_td(spark, sf_dir))
    return s.select(
        "project_id", "total_dependencies", "vulnerabilities_found", "typosquatting_alerts", "secrets_found",
        "licenses_found", "dep_confusion_issues", "pipeline_issues", "versions_outdated", "total_issues", "n_critical", "n_high", "n_medium", "n_low",
        "security_score", "band",
    )


def recommendations(spark, sf_dir):
    s = full_summary(_td(spark, sf_dir))
    return s.select("project_id", F.array_join("recommendations", " | ").alias("recommendations"))


# ------------------------------------------------------------------ more graph views
def cycle_members(spark, sf_dir):
    """G6 on the edges with back edges added: a shortest cycle per edge on one, smallest node first."""
    c = graph.cycles(_td(spark, sf_dir).cycle_edges)
    return c.select("ecosystem", F.array_join("cycle", " -> ").alias("cycle"), "length")


def dependency_chains(spark, sf_dir):
    td = _td(spark, sf_dir)
    c = graph.dependency_chains(_roots(td), td.edges)
    return c.select("project_id", "ecosystem", "name", F.array_join("chain", " -> ").alias("chain"))


def vulnerable_chains(spark, sf_dir):
    """For every package with an advisory, how many chains lead to it and the three best, per project."""
    td = _td(spark, sf_dir)
    c = graph.counted_chains(_roots(td), td.edges, td.advisories.select("ecosystem", "package"), 3)
    return c.select("project_id", "ecosystem", "name", F.col("n_chains").cast("bigint").alias("n_chains"), "rank",
                    F.array_join("chain", " -> ").alias("chain"))


def package_list(spark, sf_dir):
    """O1: all packages in order, with their positions."""
    return listing.package_list(_roots(_td(spark, sf_dir)))


def graph_nodes(spark, sf_dir):
    td = _td(spark, sf_dir)
    return scan.graph_nodes(_roots(td), td.edges)


def cycle_nodes(spark, sf_dir):
    """G6 exact: packages on any dependency cycle (edges with back edges added)."""
    return graph.cycle_nodes(_td(spark, sf_dir).cycle_edges)


def cycle_groups(spark, sf_dir):
    """The strongly connected components of the edges with back edges added."""
    return graph.components(_td(spark, sf_dir).cycle_edges)


def tree_view(spark, sf_dir):
    td = _td(spark, sf_dir)
    return scan.tree_view(_roots(td), td.edges, 2)


# ------------------------------------------------------------------ streaming
def _events(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet"


def stream_alert_counts(spark, sf_dir):
    out = stream.windowed_alert_counts(spark, _events(sf_dir))
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "category", "n_alerts"
    )


def stream_dedup(spark, sf_dir):
    return stream.dedup_alerts(spark, _events(sf_dir))


def stream_score(spark, sf_dir):
    return stream.running_scores(spark, _events(sf_dir)).select(
        "project_id", "n_critical", "n_high", "n_medium", "n_low", "security_score", "band"
    )


def stream_outdated(spark, sf_dir):
    td = _td(spark, sf_dir)
    landing = stream.scratch_dir(spark, "landing")
    stream.land_manifests(spark, td.manifests, landing)
    return stream.stream_outdated(spark, landing, td.releases).select(
        "project_id", "ecosystem", "package", "installed_version", "latest_version", "message"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "vulnerable_deps": vulnerable_deps,
    "parse_requirements": _parse("python", M.requirements_deps),
    "parse_package_json": _parse("npm", M.package_json_deps),
    "parse_gemfile": _parse("ruby", M.gemfile_deps),
    "parse_pom": _parse("maven", M.pom_deps),
    "manifest_dispatch": manifest_dispatch,
    "installed_npm": installed_npm,
    "quarantined_manifests": quarantined_manifests,
    "closure_depth": closure_depth,
    "shortest_path": shortest_path,
    "depth_compat": depth_compat,
    "graph_stats": graph_stats,
    "blast_radius": blast_radius,
    "children_counts": children_counts,
    "last_declaration": last_declaration,
    "declared_count": declared_count,
    "latest_release": latest_release,
    "outdated_deps": outdated_deps,
    "typo_candidates": typo_candidates,
    "typo_separator": _typo_technique("separator_confusion"),
    "typo_homoglyph": _typo_technique("homoglyph"),
    "typo_swap": _typo_technique("character_swap"),
    "typo_repeat": _typo_technique("repeated_character"),
    "typo_suffix": _typo_technique("version_suffix"),
    "typo_combo": _typo_technique("combosquatting"),
    "typo_edit": _typo_technique("levenshtein_distance_1", "levenshtein_distance_2"),
    "typosquat_alerts": typosquat_alerts,
    "license_inventory": license_inventory,
    "license_alerts": license_alerts,
    "license_risk_docs": license_risk_docs,
    "unregistered_deps": unregistered_deps,
    "npm_config_alerts": npm_config_alerts,
    "pip_config_alerts": pip_config_alerts,
    "pipeline_alerts": pipeline_alerts,
    "secret_alerts": secret_alerts,
    "history_secrets": history_secrets,
    "enriched_alerts": enriched_alerts,
    "project_summary": project_summary,
    "recommendations": recommendations,
    "cycle_members": cycle_members,
    "cycle_nodes": cycle_nodes,
    "cycle_groups": cycle_groups,
    "dependency_chains": dependency_chains,
    "vulnerable_chains": vulnerable_chains,
    "package_list": package_list,
    "graph_nodes": graph_nodes,
    "tree_view": tree_view,
    "stream_alert_counts": stream_alert_counts,
    "stream_dedup": stream_dedup,
    "stream_score": stream_score,
    "stream_outdated": stream_outdated,
}
