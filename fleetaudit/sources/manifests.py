"""Manifest parsers (S1–S6) as row-local DataFrame expressions.

Each parser turns one manifest row ``(project_id, path, ecosystem, content)``
into an array of dependency structs with higher-order functions and then
``posexplode``s it, so ``pos`` (1-based declaration order within the file) is
computed without any shuffle.  The output columns are those of ``_explode_deps``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetaudit.functions.text import split_lines, py_strip

# The line patterns of the four manifest syntaxes.
REQUIREMENT_LINE = r"(?d)^([a-zA-Z0-9\-_]+)(?:[=<>~]+(.*))?"
GEM_LINE = r"(?d)^gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?"
MAVEN_PROPERTY_REF = r"(?s)^\$\{(.+)\}$"
# Npm sections in the order they are read.
NPM_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
# File classification (extension / basename -> ecosystem).
PYTHON_EXTS = [".txt"]
NPM_EXTS = [".json"]
RUBY_NAMES = ["gemfile"]
RUBY_EXTS = [".gemfile", ".rb"]
MAVEN_NAMES = ["pom.xml"]
MAVEN_EXTS = [".xml", ".pom"]

DEP_COLUMNS = [
    "project_id", "path", "ecosystem", "pos", "name", "version", "dep_type", "scope", "is_dev",
    "is_optional", "source",
]

_DEP_STRUCT = (
    "struct<name:string,version:string,dep_type:string,scope:string,is_dev:boolean,is_optional:boolean>"
)


def _dep(name: Column, version: Column, dep_type=None, scope=None, is_dev=None, is_optional=None) -> Column:
    def lit_or(c, t):
        return c if isinstance(c, Column) else F.lit(c).cast(t)

    return F.struct(
        name.alias("name"),
        version.alias("version"),
        lit_or(dep_type, "string").alias("dep_type"),
        lit_or(scope, "string").alias("scope"),
        lit_or(is_dev, "boolean").alias("is_dev"),
        lit_or(is_optional, "boolean").alias("is_optional"),
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it (lambda bodies share nothing)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _explode_deps(manifests: DataFrame, deps: Column, source: str = "declared") -> DataFrame:
    out = manifests.select(
        "project_id", "path", "ecosystem", F.posexplode(deps).alias("pos0", "d")
    )
    return out.select(
        "project_id", "path", "ecosystem", (F.col("pos0") + 1).alias("pos"),
        "d.name", "d.version", "d.dep_type", "d.scope", "d.is_dev", "d.is_optional",
        F.lit(source).alias("source"),
    )


def _kept_lines(content: Column) -> Column:
    """Stripped lines, without blanks and ``#`` comments."""
    return F.filter(
        F.transform(split_lines(content), py_strip), lambda l: (l != "") & ~l.startswith("#")
    )


# PEP 508-style line for the strict mode: name, optional extras, optional specifier set
STRICT_REQUIREMENT = r"(?d)^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*((?:===|==|!=|~=|<=|>=|<|>)[^;#]*)?"


def requirements_deps_strict(manifests: DataFrame) -> DataFrame:
    """S1 strict mode (D7 opt-in): names with dots, extras, spaces and ``!=`` are read as pip reads them.

    ``pkg[extra] >= 1.0, < 2 ; python_version > "3"  # note`` -> (``pkg``, ``>= 1.0, < 2``);
    an exact ``==x`` pin gives version ``x``; option lines (``-r``, ``--index-url``) are skipped;
    no specifier gives ``latest``.
    """
    lines = F.filter(
        _kept_lines(F.col("content")), lambda l: ~l.startswith("-") & l.rlike(STRICT_REQUIREMENT)
    )

    def version(l: Column) -> Column:
        spec = py_strip(F.regexp_extract(l, STRICT_REQUIREMENT, 2))
        pinned = F.regexp_extract(spec, r"^==\s*([^,\s*]+)$", 1)
        return F.when(spec == "", F.lit("latest")).when(pinned != "", pinned).otherwise(spec)

    deps = F.transform(lines, lambda l: _dep(F.lower(F.regexp_extract(l, STRICT_REQUIREMENT, 1)), version(l)))
    return _explode_deps(manifests, deps)


# ------------------------------------------------------------------ S1
def requirements_deps(manifests: DataFrame, strict: bool = False) -> DataFrame:
    """Pip requirement lines -> (name lower-cased, version or ``latest``)."""
    if strict:
        return requirements_deps_strict(manifests)
    lines = F.filter(_kept_lines(F.col("content")), lambda l: l.rlike(REQUIREMENT_LINE))
    deps = F.transform(
        lines,
        lambda l: _dep(
            F.lower(F.regexp_extract(l, REQUIREMENT_LINE, 1)),
            F.when(F.regexp_extract(l, REQUIREMENT_LINE, 2) == "", F.lit("latest")).otherwise(
                F.regexp_extract(l, REQUIREMENT_LINE, 2)
            ),
        ),
    )
    return _explode_deps(manifests, deps)


# ------------------------------------------------------------------ S4
def gemfile_deps(manifests: DataFrame) -> DataFrame:
    """``gem 'name'[, 'constraint']`` lines; first constraint only."""
    lines = F.filter(_kept_lines(F.col("content")), lambda l: l.startswith("gem") & l.rlike(GEM_LINE))
    deps = F.transform(
        lines,
        lambda l: _dep(
            F.lower(F.regexp_extract(l, GEM_LINE, 1)),
            F.when(F.regexp_extract(l, GEM_LINE, 2) == "", F.lit("latest")).otherwise(
                F.regexp_extract(l, GEM_LINE, 2)
            ),
            dep_type="dependencies",
        ),
    )
    return _explode_deps(manifests, deps)


# ------------------------------------------------------------------ S2
def package_json_deps(manifests: DataFrame) -> DataFrame:
    """The four npm sections in fixed order; one row per (section, name).

    JSON object semantics: a repeated key keeps its first position and its last value.  The text is read
    once (``d``); only a section that repeats a key is sorted: by (key, position), where the first of a
    run of equal keys gives the position and the last the value.
    """
    schema = ", ".join(f"{s}: map<string, string>" for s in NPM_SECTIONS)

    def section(s: str) -> str:
        m = f"coalesce(d.{s}, CAST(map() AS map<string, string>))"
        by_key = f"array_sort(transform(map_entries({m}), (x, i) -> struct(x.key AS key, i AS pos, x.value AS value)))"
        runs = (
            f"transform(array({by_key}), r -> array_sort(zip_with("
            "filter(r, (x, i) -> i = 0 OR x.key <> get(r, i - 1).key), "
            "filter(r, (x, i) -> i = size(r) - 1 OR x.key <> get(r, i + 1).key), "
            "(f, l) -> struct(f.pos AS pos, f.key AS key, l.value AS value))))[0]"
        )
        dep = (
            "struct(lower(e.key) AS name, e.value AS version, "
            f"'{s}' AS dep_type, CAST(NULL AS STRING) AS scope, {str(s == 'devDependencies').lower()} AS is_dev, "
            f"{str(s == 'optionalDependencies').lower()} AS is_optional)"
        )
        return (
            f"if(size(array_distinct(map_keys({m}))) = size(map_keys({m})), "
            f"transform(map_entries({m}), e -> {dep}), transform({runs}, e -> {dep}))"
        )

    found = f"concat({', '.join(map(section, NPM_SECTIONS))})"
    deps = F.expr(
        f"transform(array(from_json(content, 'struct<{schema}>')), "
        f"d -> if(d IS NULL, CAST(array() AS array<{_DEP_STRUCT}>), {found}))[0]"
    )
    return _explode_deps(manifests, deps)


# ------------------------------------------------------------------ S3
def installed_npm_deps(text_files: DataFrame) -> DataFrame:
    """S3: ``node_modules/<pkg>/package.json`` next to the manifest -> transitive rows.

    Only the top level is read (a scoped ``@x/y`` folder has no package.json of
    its own), the name is the folder name lower-cased, version or ``unknown``;
    unparsable JSON is skipped.
    """
    folder = F.regexp_extract(F.col("path"), r"^node_modules/([^/]+)/package\.json$", 1)
    doc = F.from_json(F.col("content"), "struct<version:string>")
    rows = text_files.filter(folder != "").filter(F.json_object_keys(F.col("content")).isNotNull())
    return rows.select(
        "project_id",
        F.lit("package.json").alias("path"),
        F.lit("npm").alias("ecosystem"),
        F.lit(None).cast("int").alias("pos"),
        F.lower(folder).alias("name"),
        F.coalesce(doc["version"], F.lit("unknown")).alias("version"),
        F.lit("transitive").alias("dep_type"),
        F.lit(None).cast("string").alias("scope"),
        F.lit(None).cast("boolean").alias("is_dev"),
        F.lit(None).cast("boolean").alias("is_optional"),
        F.lit("installed").alias("source"),
    )


# ------------------------------------------------------------------ S5
# the rest of an opening tag that is not self-closing: attributes or white space
ATTRIBUTES = r"(?:\s(?:[^<>]*[^<>/])?)?"


def malformed_xml(content: Column) -> Column:
    """True where the text is not a well-formed XML document."""
    read = F.from_xml(content, "_bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return F.coalesce(read["_bad"].isNotNull() | content.isNull(), F.lit(True))


def malformed_json(content: Column) -> Column:
    """True where the text is not a JSON object."""
    return F.json_object_keys(content).isNull()


def _decoded(text: Column) -> Column:
    """Character references (``&#46;``, ``&#x2E;``) and the five predefined XML entities."""
    def number(part: Column) -> Column:
        ref, rest = F.regexp_extract(part, r"(?s)^(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});(.*)$", 1), F.regexp_extract(part, r"(?s)^[^;]*;(.*)$", 1)
        code = F.when(ref.startswith("x"), F.lpad(F.substr(ref, F.lit(2)), 8, "0")).otherwise(F.lpad(F.hex(ref.cast("bigint")), 8, "0"))
        char = F.decode(F.unhex(code), "UTF-32")
        return F.when(ref == "", F.concat(F.lit("&#"), part)).otherwise(
            F.concat(F.when(char == "&", F.lit("&amp;")).otherwise(char), rest))

    parts = F.split(text, "&#")
    text = F.when(F.contains(text, F.lit("&#")), F.array_join(
        F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(number(x))), "")).otherwise(text)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def plain_xml(content: Column) -> Column:
    """The same elements and texts without comments, CDATA sections and the root element's prefix.

    Texts of CDATA sections are escaped as ordinary text.  Elements with another prefix than the root's
    belong to another namespace and keep it.
    """
    def escaped(part: Column) -> Column:
        said = F.substring_index(part, "]]>", 1)
        rest = F.substr(part, F.length(said) + 4)
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            said = F.replace(said, F.lit(char), F.lit(name))
        return F.concat(said, rest)

    def unwrapped(c: Column) -> Column:
        sections = F.split(c, r"<!\[CDATA\[")
        return F.when(F.contains(c, F.lit("<![CDATA[")), F.array_join(
            F.transform(sections, lambda x, i: F.when(i == 0, x).otherwise(escaped(x))), "")).otherwise(c)

    def bare(c: Column) -> Column:
        prefix = F.regexp_extract(c, r"(?s)^(?:\s|<\?.*?\?>|<!DOCTYPE[^>]*>)*<([A-Za-z_][\w.\-]*):", 1)
        return _bound(prefix, lambda p: F.when(p == "", c).otherwise(
            F.replace(F.replace(c, F.concat(F.lit("<"), p, F.lit(":")), F.lit("<")), F.concat(F.lit("</"), p, F.lit(":")), F.lit("</"))))

    # comments go; a comment's marks inside a CDATA section are text
    c = F.regexp_replace(content, r"(?s)<!--.*?-->|(<!\[CDATA\[.*?\]\]>)", "$1")
    return _bound(_bound(c, unwrapped), bare)


def pom_deps(manifests: DataFrame) -> DataFrame:
    """Every ``<dependency>`` at any depth; ``${p}`` from the first ``<properties>``.

    Comments, CDATA sections and a prefix of the root's namespace are resolved first (``plain_xml``), as an
    XML parser does; texts that are not well-formed give no rows (``parse_manifests`` quarantines them).

    A text is read once: each step is bound (``_bound``) before the next one uses it several times, and the
    properties are found per text, not per dependency.
    """
    prop_re = r"(?s)<([A-Za-z_][\w.\-]*)\s*>([^<]*)</\1\s*>"

    def child(block: Column, tag: str) -> Column:
        # direct child only: nested exclusions are removed first
        return F.regexp_extract(block, rf"(?s)<{tag}{ATTRIBUTES}>(.*?)</{tag}\s*>", 1)

    def has_child(block: Column, tag: str) -> Column:
        return block.rlike(rf"<{tag}{ATTRIBUTES}>") | block.rlike(rf"<{tag}(?:\s[^<>]*)?/>")

    def said(b: Column) -> Column:
        tags = ("groupId", "artifactId", "version", "scope")
        return F.struct(*[child(b, t).alias(t) for t in tags], *[has_child(b, t).alias(f"has_{t}") for t in tags])

    def texts(x: Column) -> Column:
        version = py_strip(_decoded(x["version"]))
        return F.struct(
            (x["has_groupId"] & x["has_artifactId"]).alias("ok"),
            F.lower(F.concat(py_strip(_decoded(x["groupId"])), F.lit(":"), py_strip(_decoded(x["artifactId"])))).alias("name"),
            F.when(x["has_version"], version).otherwise("").alias("version"),
            F.when(x["has_scope"], _decoded(x["scope"])).otherwise("").alias("scope"),
        )

    def resolved(x: Column, props: Column) -> Column:
        ref = F.regexp_extract(x["version"], MAVEN_PROPERTY_REF, 1)

        def looked_up(r: Column) -> Column:
            hit = F.filter(props, lambda p: p["k"] == r)
            return _bound(hit, lambda h: F.when((r != "") & (F.size(h) > 0), py_strip(_decoded(F.try_element_at(h, F.lit(-1))["v"])))
                          .otherwise(x["version"]))

        version = F.when(x["version"] == "", F.lit("latest")).otherwise(_bound(ref, looked_up))
        scope = F.when(x["scope"] == "", F.lit("compile")).otherwise(py_strip(x["scope"]))
        return _dep(x["name"], version, dep_type="dependencies", scope=scope, is_dev=scope.isin("test", "provided"))

    def read(c: Column) -> Column:
        block = F.regexp_extract(c, r"(?s)<properties\s*>(.*?)</properties\s*>", 1)
        props = _bound(block, lambda t: F.zip_with(
            F.regexp_extract_all(t, F.lit(prop_re), 1), F.regexp_extract_all(t, F.lit(prop_re), 2),
            lambda k, v: F.struct(py_strip(k).alias("k"), v.alias("v"))))
        blocks = F.regexp_extract_all(c, F.lit(rf"(?s)<dependency{ATTRIBUTES}>(.*?)</dependency\s*>"), 1)
        bare = F.transform(blocks, lambda b: F.regexp_replace(b, rf"(?s)<exclusions{ATTRIBUTES}>.*?</exclusions\s*>", ""))
        found = F.filter(F.transform(F.transform(bare, said), texts), lambda x: x["ok"])
        return _bound(F.struct(props.alias("props"), found.alias("found")),
                      lambda t: F.transform(t["found"], lambda x: resolved(x, t["props"])))

    deps = _bound(F.col("content"), lambda c: F.when(~malformed_xml(c), _bound(plain_xml(c), read)))
    return _explode_deps(manifests, deps)


# ------------------------------------------------------------------ S6
def classify_manifest(path: Column) -> Column:
    """Ecosystem of a manifest path (NULL = unsupported)."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    ext = F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1)
    return (
        F.when(ext.isin(*PYTHON_EXTS), F.lit("python"))
        .when(ext.isin(*NPM_EXTS), F.lit("npm"))
        .when(base.isin(*RUBY_NAMES) | ext.isin(*RUBY_EXTS), F.lit("ruby"))
        .when(base.isin(*MAVEN_NAMES) | ext.isin(*MAVEN_EXTS), F.lit("maven"))
    )


def quarantined(manifests: DataFrame) -> DataFrame:
    """(project_id, path, reason) of the manifests that no parser reads."""
    eco = classify_manifest(F.col("path"))
    reason = (
        F.when(eco.isNull(), "unsupported path")
        .when((eco == "npm") & malformed_json(F.col("content")), "malformed JSON")
        .when(eco == "maven", F.when(malformed_xml(F.col("content")), "malformed XML"))
    )
    return manifests.select("project_id", "path", reason.alias("reason")).filter("reason is not null")


def parse_manifests(manifests: DataFrame, text_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Dispatch every manifest to its parser.

    Returns ``(dependencies, quarantine)``; unsupported paths and malformed
    JSON or XML go to the quarantine frame, with a reason, instead of failing the job.  When ``text_files`` is
    given, installed npm packages are appended to npm projects (U2).
    """
    m = manifests.withColumn("ecosystem", classify_manifest(F.col("path")))
    parsers = {
        "python": requirements_deps,
        "npm": package_json_deps,
        "ruby": gemfile_deps,
        "maven": pom_deps,
    }
    parts = [fn(m.filter(F.col("ecosystem") == eco)) for eco, fn in parsers.items()]
    deps = parts[0]
    for p in parts[1:]:
        deps = deps.unionByName(p)
    if text_files is not None:
        npm_projects = m.filter(F.col("ecosystem") == "npm").select("project_id").distinct()
        deps = deps.unionByName(installed_npm_deps(text_files).join(npm_projects, "project_id", "left_semi"))
    return deps, quarantined(manifests)


# Manifest file names looked for at a project's root.
MANIFEST_ROOT_NAMES = ["requirements.txt", "package.json", "Gemfile", "pom.xml"]


def manifest_files(text_files: DataFrame) -> DataFrame:
    """Project-root manifests of a tree: the well-known names plus ``*.gemfile`` / ``*.pom``.

    (The dispatch rule S6 classifies a given manifest path; this picks which
    files of a whole project tree are manifests, so a ``docs/notes.txt`` is not
    read as a requirements file.)
    """
    p = F.col("path")
    root_level = ~p.contains("/")
    named = p.isin(*MANIFEST_ROOT_NAMES) | F.lower(p).endswith(".gemfile") | F.lower(p).endswith(".pom")
    return text_files.filter(root_level & named)
