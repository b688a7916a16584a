"""Loaders for landed JSON feeds and lookup snapshots.

The original tool calls registries and advisory APIs per package over HTTP.
Here those responses are landed files (JSON lines, one response per
package) read by Spark and flattened with ``from_json``/``explode``; the
lookups become (ecosystem, package)-keyed tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetaudit.sources import popular_default

ECOSYSTEMS = ["python", "npm", "ruby", "maven"]


def _whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """Known-dependency JSON ``{eco: {package: [child, ...]}}`` -> edges(ecosystem, parent, child).

    Unparsable files give no rows (as a missing/bad file gives an empty graph).
    """
    doc = F.from_json(F.col("value"), "map<string,map<string,array<string>>>")
    ecos = _whole_text(spark, path).select(F.explode(doc).alias("ecosystem", "pkgs"))
    pkgs = ecos.select("ecosystem", F.explode("pkgs").alias("parent", "children"))
    return pkgs.select(
        "ecosystem", F.lower("parent").alias("parent"), F.explode(F.transform("children", F.lower)).alias("child")
    ).distinct()


def popular_from_groups(groups: DataFrame, ecosystems: list[str] = ECOSYSTEMS) -> DataFrame:
    """groups(group, name) -> popular(ecosystem, name).

    python and npm use their own list plus ``shared``; any other ecosystem
    uses the union of all lists.
    """
    parts = []
    for eco in ecosystems:
        if eco in ("python", "npm"):
            rows = groups.filter(F.col("group").isin(eco, "shared"))
        else:
            rows = groups
        parts.append(rows.select(F.lit(eco).alias("ecosystem"), F.lower("name").alias("name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def load_popular(spark: SparkSession, path: str | None = None, ecosystems: list[str] = ECOSYSTEMS) -> DataFrame:
    """Popular names from a JSON file ``{python: [...], npm: [...], shared: [...]}``, or the built-in list."""
    if path is None:
        return popular_from_groups(popular_default.groups_frame(spark), ecosystems)
    doc = F.from_json(F.col("value"), "map<string,array<string>>")
    groups = _whole_text(spark, path).select(F.explode(doc).alias("group", "names")).select(
        "group", F.explode("names").alias("name"))
    return popular_from_groups(groups, ecosystems)


def load_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Landed advisory responses -> advisories(ecosystem, package, cve, severity, affected_versions,
    summary, description).

    Input: JSON lines ``{"ecosystem", "package", "response": <GraphQL response>}`` where the
    response holds ``data.securityVulnerabilities.nodes[{advisory{cveId, severity, summary,
    description}, vulnerableVersionRange}]``.
    """
    schema = (
        "ecosystem string, package string, response struct<data: struct<securityVulnerabilities: struct<nodes: "
        "array<struct<advisory: struct<cveId: string, severity: string, summary: string, description: string>, "
        "vulnerableVersionRange: string>>>>>"
    )
    raw = spark.read.schema(schema).json(path)
    nodes = raw.select(
        "ecosystem", F.lower("package").alias("package"),
        F.explode_outer("response.data.securityVulnerabilities.nodes").alias("n"),
    ).filter(F.col("n").isNotNull())
    return nodes.select(
        "ecosystem", "package",
        F.coalesce(F.col("n.advisory.cveId"), F.lit("Unknown")).alias("cve"),
        F.coalesce(F.col("n.advisory.severity"), F.lit("UNKNOWN")).alias("severity"),
        F.coalesce(F.col("n.vulnerableVersionRange"), F.lit("")).alias("affected_versions"),
        F.coalesce(F.col("n.advisory.summary"), F.lit("")).alias("summary"),
        F.coalesce(F.col("n.advisory.description"), F.lit("")).alias("description"),
    )


def load_nvd(spark: SparkSession, path: str) -> DataFrame:
    """Landed NVD keyword responses -> advisories with no version range (every version matches)."""
    schema = (
        "ecosystem string, package string, response struct<result: struct<CVE_Items: array<struct<"
        "cve: struct<CVE_data_meta: struct<ID: string>, description: struct<description_data: "
        "array<struct<value: string>>>>, impact: struct<baseMetricV3: struct<cvssV3: struct<baseSeverity: "
        "string>>>>>>>"
    )
    raw = spark.read.schema(schema).json(path)
    items = raw.select("ecosystem", F.lower("package").alias("package"),
                       F.explode("response.result.CVE_Items").alias("i"))
    return items.select(
        "ecosystem", "package", F.col("i.cve.CVE_data_meta.ID").alias("cve"),
        F.coalesce(F.col("i.impact.baseMetricV3.cvssV3.baseSeverity"), F.lit("UNKNOWN")).alias("severity"),
        F.lit(None).cast("string").alias("affected_versions"),
        F.lit(None).cast("string").alias("summary"),
        F.try_element_at(F.col("i.cve.description.description_data"), F.lit(1))["value"].alias("description"),
    )


def _registry_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"ecosystem", "package", "body": "<registry JSON as text>"}``."""
    return spark.read.schema("ecosystem string, package string, body string").json(path)


def _j(path: str) -> Column:
    return F.get_json_object(F.col("body"), path)


def load_licenses(spark: SparkSession, path: str) -> DataFrame:
    """Registry metadata -> licenses(ecosystem, package, license).

    pypi: ``info.license``, else the last ``::`` part of the first ``License ::``
    classifier; npm: ``license`` text or ``license.type``; ruby: ``licenses``
    joined by ``, ``; maven: none.
    """
    rows = _registry_rows(spark, path)
    classifiers = F.from_json(_j("$.info.classifiers"), "array<string>")
    first_lic = F.try_element_at(F.filter(classifiers, lambda c: c.startswith("License ::")), F.lit(1))
    from_classifier = F.trim(F.element_at(F.split(first_lic, "::"), -1))
    py_lic = _j("$.info.license")
    pypi = F.when((py_lic.isNull()) | (F.trim(py_lic) == "") | (py_lic == "Unknown"), from_classifier).otherwise(
        py_lic)
    npm_obj = F.from_json(_j("$.license"), "struct<type:string>")
    npm = F.when(_j("$.license").startswith("{"), npm_obj["type"]).otherwise(_j("$.license"))
    ruby = F.array_join(F.from_json(_j("$.licenses"), "array<string>"), ", ")
    eco = F.col("ecosystem")
    lic = F.when(eco == "python", pypi).when(eco == "npm", npm).when(eco == "ruby", F.nullif(ruby, F.lit("")))
    return rows.select("ecosystem", F.lower("package").alias("package"),
                       F.coalesce(lic, F.lit("Unknown")).alias("license"))


def load_latest(spark: SparkSession, path: str) -> DataFrame:
    """Registry metadata -> releases(ecosystem, package, version) with the registry's latest version."""
    rows = _registry_rows(spark, path)
    eco = F.col("ecosystem")
    v = (
        F.when(eco == "python", _j("$.info.version"))
        .when(eco.isin("npm", "ruby"), _j("$.version"))
        .when(eco == "maven", _j("$.response.docs[0].latestVersion"))
    )
    return rows.select("ecosystem", F.lower("package").alias("package"),
                       F.coalesce(v, F.lit("0.0.0")).alias("version"))


def refresh_snapshot(spark: SparkSession, snapshot_path: str, fresh: DataFrame,
                     keys: tuple[str, ...] = ("ecosystem", "package")) -> DataFrame:
    """Append to a Parquet lookup snapshot only the keys it does not hold yet.

    Negative results are rows too (e.g. licence ``Unknown``), so a key is looked
    up once; there is no expiry, as in the original caches.
    """
    try:
        existing = spark.read.parquet(snapshot_path)
        new = fresh.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # only a missing snapshot means "first write"
            raise
        new = fresh
    new.write.mode("append").parquet(snapshot_path)
    return spark.read.parquet(snapshot_path)


def _fs_and_base(root: str):
    import os

    import pyarrow.fs as pafs

    if "://" in root and not root.startswith("file://"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), os.path.abspath(root.replace("file://", ""))


def read_project_tree(spark: SparkSession, root: str, files_per_task: int = 512) -> DataFrame:
    """S15–S17 input: every file below ``root/<project>/...`` -> text_files(project_id, path, content).

    Spark's file sources skip hidden paths (``.github/``, ``.gitlab-ci.yml``,
    ``.npmrc``, ``.env``), which are exactly the CI and config files scanned
    here, so the tree is walked with ``pyarrow.fs`` inside tasks:

    1. the driver lists only the top-level project folders;
    2. tasks list each project's files (metadata only, hidden ones included);
    3. the (project, file) list is repartitioned evenly and tasks read the
       contents — a project holding a third of all files is spread over many
       tasks for the reading.

    ``path`` is relative to the project folder; undecodable bytes are replaced.
    """
    import pyarrow.fs as pafs

    fs, base = _fs_and_base(root)
    projects = [
        i.base_name for i in fs.get_file_info(pafs.FileSelector(base))
        if i.type == pafs.FileType.Directory
    ]
    if not projects:
        return spark.createDataFrame([], "project_id string, path string, content string")

    def list_files(batches):
        import pandas as pd
        import pyarrow.fs as pafs

        fs2, base2 = _fs_and_base(root)
        for pdf in batches:
            out = []
            for proj in pdf["project_id"]:
                prefix = f"{base2}/{proj}"
                for info in fs2.get_file_info(pafs.FileSelector(prefix, recursive=True)):
                    if info.type == pafs.FileType.File:
                        out.append((proj, info.path[len(prefix) + 1:]))
            yield pd.DataFrame(out, columns=["project_id", "path"])

    def read_files(batches):
        import pandas as pd

        fs2, base2 = _fs_and_base(root)
        for pdf in batches:
            contents = []
            for proj, path in zip(pdf["project_id"], pdf["path"]):
                with fs2.open_input_stream(f"{base2}/{proj}/{path}") as fh:
                    contents.append(fh.read().decode("utf-8", errors="replace"))
            yield pd.DataFrame({"project_id": pdf["project_id"], "path": pdf["path"], "content": contents})

    proj_df = spark.createDataFrame([(p,) for p in projects], "project_id string")
    n_list = max(1, min(len(projects), spark.sparkContext.defaultParallelism * 4))
    listed = proj_df.repartition(n_list).mapInPandas(list_files, "project_id string, path string")
    listed = listed.persist()
    n_files = listed.count()
    n_read = max(1, -(-n_files // files_per_task))
    return listed.repartition(n_read).mapInPandas(read_files, "project_id string, path string, content string")
