"""DuckDB oracle SQL for every registered query.

The derived tables are rebuilt here in DuckDB SQL from the same parquet views
(``part``, ``lineitem``, ``supplier``, ``documents``), and each operator is
re-expressed the plain way: brute-force comparisons instead of keyed joins,
recursive CTEs instead of the hop loop, RE2 regexes instead of Java ones,
integer lists instead of PEP 440 structs (the derived versions are plain
``x.y.z``; pre-releases and non-numeric strings are never inside a range).
"""

from __future__ import annotations

# The expected values are written out here, not imported from the code under test.
TECHNIQUES = {
    "separator_confusion": (1, "HIGH", "HIGH"),
    "character_swap": (2, "HIGH", "HIGH"),
    "repeated_character": (3, "MEDIUM", "MEDIUM"),
    "homoglyph": (4, "CRITICAL", "CRITICAL"),
    "version_suffix": (5, "HIGH", "HIGH"),
    "combosquatting": (6, "LOW", "MEDIUM"),
    "levenshtein_distance_1": (7, "HIGH", "HIGH"),
    "levenshtein_distance_2": (8, "MEDIUM", "MEDIUM"),
}
MESSAGES = {
    "levenshtein_distance_1": "Edit distance 1: '%s' is 1 character away from popular package '%s'",
    "levenshtein_distance_2": "Edit distance 2: '%s' is 2 characters away from popular package '%s'",
    "separator_confusion": "Separator confusion: '%s' normalizes to the same name as '%s' when dashes, "
                           "underscores and dots are removed",
    "character_swap": "Adjacent character swap: '%s' has characters swapped compared to '%s'",
    "repeated_character": "Repeated character: '%s' has a duplicated character compared to '%s'",
    "homoglyph": "Homoglyph attack: '%s' uses visually similar characters to mimic '%s'",
    "version_suffix": "Version suffix squatting: '%s' is '%s' with a trailing digit",
    "combosquatting": "Combosquatting: '%s' embeds the popular package name '%s'",
}

ECOS = "['python','npm','ruby','maven']"
SECTIONS = "['dependencies','devDependencies','peerDependencies','optionalDependencies']"


def vk(x: str) -> str:
    """Numeric release list with trailing zeros removed."""
    return (
        f"list_transform(string_split(regexp_replace({x}, '(\\.0+)+$', ''), '.'), "
        "lambda s: TRY_CAST(s AS BIGINT))"
    )


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PACKAGES = f"""
packages AS (
  SELECT *, CASE WHEN ecosystem = 'maven' THEN group_id || ':' || artifact ELSE artifact END AS name
  FROM (
    SELECT *, CASE mutation
        WHEN 0 THEN 'internal-' || CAST(p_partkey AS VARCHAR)
        WHEN 1 THEN replace(base, '-', '_')
        WHEN 2 THEN substr(base, 2, 1) || substr(base, 1, 1) || substr(base, 3)
        WHEN 3 THEN substr(base, 1, 1) || base
        WHEN 4 THEN translate(base, 'ol', '01')
        WHEN 5 THEN base || CAST(p_partkey % 10 AS VARCHAR)
        WHEN 6 THEN CASE p_partkey % 3 WHEN 0 THEN base || '-lib' WHEN 1 THEN substr(base, 2)
                    ELSE substr(base, 3) END
        ELSE base END AS artifact
    FROM (
      SELECT p_partkey, p_size, p_retailprice, p_brand, replace(lower(p_name), ' ', '-') AS base,
             CAST((p_partkey // 4) % 8 AS INTEGER) AS mutation,
             {ECOS}[p_partkey % 4 + 1] AS ecosystem,
             'org.' || replace(lower(p_brand), '#', '') AS group_id
      FROM part) b) m)"""

DEPS = f"""
deps_g AS (
  SELECT l.l_orderkey AS project_id, k.ecosystem, k.name, min(l.l_linenumber) AS first_line,
         min(l.l_partkey) AS pk, min(l.l_suppkey) AS supp, CAST(floor(min(l.l_quantity)) AS INTEGER) AS qty
  FROM lineitem l JOIN packages k ON l.l_partkey = k.p_partkey
  GROUP BY 1, 2, 3),
deps_s AS (
  SELECT *,
    CASE WHEN ecosystem = 'npm' AND (pk + first_line) % 8 <= 3 THEN (pk + first_line) % 8 ELSE 0 END AS section_idx,
    CAST(supp % 4 AS VARCHAR) || '.' || CAST(first_line % 3 AS VARCHAR) || '.' || CAST(qty % 20 AS VARCHAR) AS core
  FROM deps_g),
deps AS (
  SELECT project_id, ecosystem,
    CAST(row_number() OVER (PARTITION BY project_id, ecosystem ORDER BY section_idx, first_line, pk) AS INTEGER) AS pos,
    name,
    CASE ecosystem
      WHEN 'python' THEN CASE WHEN qty > 45 THEN 'latest' WHEN qty % 10 = 0 THEN core || 'rc1' ELSE core END
      WHEN 'npm' THEN CASE WHEN pk % 2 = 0 THEN '^' || core ELSE core END
      WHEN 'ruby' THEN CASE WHEN qty > 45 THEN 'latest' ELSE '~> ' || core END
      ELSE CASE WHEN qty > 45 THEN 'latest' ELSE core END END AS version,
    CASE WHEN ecosystem = 'npm' THEN {SECTIONS}[section_idx + 1]
         WHEN ecosystem IN ('ruby', 'maven') THEN 'dependencies' END AS dep_type,
    CASE WHEN ecosystem = 'maven' THEN CASE pk % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'provided' ELSE 'compile' END
         END AS scope,
    CASE WHEN ecosystem = 'npm' THEN section_idx = 1 WHEN ecosystem = 'maven' THEN pk % 5 IN (0, 1) END AS is_dev,
    CASE WHEN ecosystem = 'npm' THEN section_idx = 3 END AS is_optional,
    pk
  FROM deps_s)"""

EDGES = """
edges AS (
  SELECT DISTINCT e.ecosystem, e.parent, c.name AS child
  FROM (SELECT ecosystem, name AS parent,
               unnest([2 * p_partkey + 1, 2 * p_partkey + 2, 3 * p_partkey + 1]) AS j
        FROM packages WHERE mutation = 0) e
  JOIN packages c ON c.p_partkey = e.j)"""

RESOLVED = """
walk(ecosystem, root, node, depth, path) AS (
  SELECT DISTINCT ecosystem, name, name, 0, [name] FROM deps
  UNION ALL
  SELECT w.ecosystem, w.root, e.child, w.depth + 1, list_append(w.path, e.child)
  FROM walk w JOIN edges e ON e.ecosystem = w.ecosystem AND e.parent = w.node
  WHERE NOT list_contains(w.path, e.child)),
closure AS (
  SELECT ecosystem, root, node, min({'d': depth, 'p': path}) AS best FROM walk GROUP BY ALL),
reach AS (
  SELECT d.project_id, d.ecosystem, c.node AS name, min(c.best) AS best
  FROM deps d JOIN closure c ON c.ecosystem = d.ecosystem AND c.root = d.name
  GROUP BY ALL),
resolved AS (
  SELECT r.project_id, r.ecosystem, r.name,
    d.name IS NOT NULL AS is_direct,
    CASE WHEN d.name IS NOT NULL THEN d.version ELSE 'transitive' END AS version,
    CASE WHEN d.name IS NOT NULL THEN coalesce(d.dep_type, 'direct') ELSE 'transitive' END AS dep_type,
    CAST(CASE WHEN d.name IS NOT NULL THEN 0 ELSE r.best.d END AS INTEGER) AS depth,
    CASE WHEN d.name IS NOT NULL THEN [r.name] ELSE r.best.p END AS path
  FROM reach r LEFT JOIN deps d
    ON d.project_id = r.project_id AND d.ecosystem = r.ecosystem AND d.name = r.name)"""

ADVISORIES = """
advisories_t AS (
  SELECT ecosystem, name AS package, 'CVE-2024-' || CAST(p_partkey AS VARCHAR) AS cve,
    ['CRITICAL','HIGH','MODERATE','LOW'][p_size % 5 + 1] AS severity,
    CASE p_partkey % 6
      WHEN 0 THEN '<' || CAST(p_size % 4 AS VARCHAR) || '.' || CAST(p_partkey % 3 AS VARCHAR)
      WHEN 1 THEN '>=0.' || CAST(p_partkey % 3 AS VARCHAR) || ',<' || CAST(p_size % 4 AS VARCHAR) || '.2'
      WHEN 2 THEN '*'
      WHEN 3 THEN '==' || CAST(p_size % 4 AS VARCHAR) || '.*'
      WHEN 4 THEN '= ' || CAST(p_size % 4 AS VARCHAR) || '.' || CAST(p_partkey % 3 AS VARCHAR) || '.0'
      ELSE '<=' || CAST(p_size % 4 AS VARCHAR) || '.1.5' END AS affected_versions,
    CASE WHEN p_partkey % 2 = 0 THEN 'Issue in ' || name END AS summary
  FROM packages WHERE p_partkey % 7 = 0)"""

RELEASES = """
releases_t AS (
  SELECT ecosystem, name AS package,
    CAST(p_size % 5 AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR) || '.'
      || CAST(CAST(floor(p_retailprice) AS BIGINT) % 10 AS VARCHAR) AS version
  FROM packages),
latest_t AS (
  SELECT ecosystem, package, arg_max(version, vk) AS latest
  FROM (SELECT *, VK_VERSION AS vk FROM releases_t) GROUP BY ALL)""".replace("VK_VERSION", vk("version"))

LICENSES = """
licenses_t AS (
  SELECT ecosystem, name AS package, min({'k': p_partkey, 'l': lic}).l AS license
  FROM (SELECT ecosystem, name, p_partkey,
          ['MIT','Apache-2.0','BSD-3-Clause','GPL-3.0','LGPL-2.1','Proprietary Commercial','EPL-2.0'][p_size % 8 + 1]
            AS lic
        FROM packages) GROUP BY ALL
  HAVING min({'k': p_partkey, 'l': lic}).l IS NOT NULL)"""

REGISTRY = """
registry_t AS (SELECT DISTINCT ecosystem, name AS package FROM packages WHERE p_partkey % 5 <> 0)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(ctes)


BASE = [PACKAGES, DEPS]
GRAPH = [PACKAGES, DEPS, EDGES, RESOLVED]


# ------------------------------------------------------------------ range test on plain versions
def in_range_sql(v: str, r: str) -> str:
    clause = (
        "CASE WHEN c LIKE '<=%' THEN VK_V <= VK(trim(substr(c, 3)))"
        " WHEN c LIKE '>=%' THEN VK_V >= VK(trim(substr(c, 3)))"
        " WHEN c LIKE '==%.*' THEN "
        "   list_transform(range(1, len(string_split(trim(substr(c, 3, length(c) - 4)), '.')) + 1),"
        "     lambda i: coalesce(TRY_CAST(string_split(V, '.')[i] AS BIGINT), 0))"
        "   = list_transform(string_split(trim(substr(c, 3, length(c) - 4)), '.'), lambda s: TRY_CAST(s AS BIGINT))"
        " WHEN c LIKE '==%' THEN VK_V = VK(trim(substr(c, 3)))"
        " WHEN c LIKE '<%' THEN VK_V < VK(trim(substr(c, 2)))"
        " WHEN c LIKE '>%' THEN VK_V > VK(trim(substr(c, 2)))"
        " ELSE false END"
    )
    clause = clause.replace("VK_V", vk(v)).replace("V,", f"{v},")
    # VK(x) -> vk(x)
    out = []
    i = 0
    while True:
        j = clause.find("VK(", i)
        if j < 0:
            out.append(clause[i:])
            break
        out.append(clause[i:j])
        depth, k = 0, j + 2
        while True:
            if clause[k] == "(":
                depth += 1
            elif clause[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(vk(clause[j + 3:k]))
        i = k + 1
    clause = "".join(out)
    return (
        f"CASE WHEN {r} IS NULL OR {r} = '' OR {r} = '*' THEN true "
        f"WHEN NOT regexp_full_match({v}, '[0-9]+(\\.[0-9]+)*') THEN false "
        f"WHEN NOT list_bool_and(list_transform(string_split({r}, ','), "
        f"lambda c: regexp_full_match(trim(c), '(<=|>=|==|<|>)\\s*[0-9]+(\\.[0-9]+)*(\\.\\*)?'))) THEN false "
        f"ELSE list_bool_and(list_transform(list_transform(string_split({r}, ','), lambda x: trim(x)), "
        f"lambda c: {clause})) END"
    )


# ------------------------------------------------------------------ typosquatting (brute force)
def typo_ctes(names_sql: str) -> list[str]:
    homo = "translate(replace(replace(replace(replace(lower(X), 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), 'nn', 'm'), " \
           "'01345789', 'oleastbg')"
    sep = "lower(translate(X, '-_.', ''))"
    swap = (
        "length(c.name) = length(p.pname) AND len(list_filter(range(1, length(c.name)), lambda i: "
        "substr(c.name, i, 1) <> substr(c.name, i + 1, 1) AND "
        "left(c.name, i - 1) || substr(c.name, i + 1, 1) || substr(c.name, i, 1) || substr(c.name, i + 2) = p.pname"
        ")) > 0"
    )

    def rep(a: str, b: str) -> str:
        return (
            f"(length({a}) = length({b}) + 1 AND len(list_filter(range(1, length({a})), lambda i: "
            f"substr({a}, i, 1) = substr({a}, i + 1, 1) AND left({a}, i - 1) || substr({a}, i + 1) = {b})) > 0)"
        )

    suffix = (
        "length(c.name) = length(p.pname) + 1 AND regexp_matches(right(c.name, 1), '^[0-9]$') "
        "AND left(c.name, length(c.name) - 1) = p.pname"
    )
    rem = "left(c.name, instr(c.name, p.pname) - 1) || substr(c.name, instr(c.name, p.pname) + length(p.pname))"
    combo = (
        "length(p.pname) >= 4 AND length(c.name) > length(p.pname) AND length(c.name) - length(p.pname) <= 6 "
        f"AND (starts_with(c.name, p.pname) OR ends_with(c.name, p.pname)) AND {rem} NOT IN ('', '-', '_', '.')"
    )
    tech_rows = ", ".join(
        f"({p}, {_lit(t)}, {_lit(c)}, {_lit(s)})" for t, (p, c, s) in TECHNIQUES.items()
    )
    return [
        f"names AS ({names_sql})",
        "pop AS (SELECT DISTINCT ecosystem, base AS pname FROM packages)",
        "cand AS (SELECT * FROM names n WHERE NOT EXISTS "
        "(SELECT 1 FROM pop p WHERE p.ecosystem = n.ecosystem AND p.pname = n.name))",
        f"sepk AS (SELECT ecosystem, {sep.replace('X', 'pname')} AS k, min(pname) AS to_ FROM pop GROUP BY ALL)",
        f"homok AS (SELECT ecosystem, {homo.replace('X', 'pname')} AS k, min(pname) AS to_ FROM pop GROUP BY ALL)",
        f"""loop_ AS (
  SELECT c.ecosystem, c.name, p.pname, s.to_ AS sep_to, h.to_ AS homo_to,
    CASE WHEN s.to_ IS NOT NULL AND s.to_ <> c.name THEN 1
         WHEN {swap} THEN 2
         WHEN {rep('c.name', 'p.pname')} OR {rep('p.pname', 'c.name')} THEN 3
         WHEN h.to_ IS NOT NULL AND h.to_ <> c.name THEN 4
         WHEN {suffix} THEN 5
         WHEN {combo} THEN 6
         WHEN levenshtein(c.name, p.pname) = 1 THEN 7
         WHEN levenshtein(c.name, p.pname) = 2 THEN 8 END AS prio
  FROM cand c JOIN pop p ON p.ecosystem = c.ecosystem
  LEFT JOIN sepk s ON s.ecosystem = c.ecosystem AND s.k = {sep.replace('X', 'c.name')}
  LEFT JOIN homok h ON h.ecosystem = c.ecosystem AND h.k = {homo.replace('X', 'c.name')})""",
        f"tech(prio, technique, confidence, severity) AS (VALUES {tech_rows})",
        """typo AS (
  SELECT DISTINCT l.ecosystem, l.name,
    CASE l.prio WHEN 1 THEN l.sep_to WHEN 4 THEN l.homo_to ELSE l.pname END AS similar_to,
    t.technique, t.confidence, t.severity
  FROM loop_ l JOIN tech t ON t.prio = l.prio)""",
    ]


def typo_message_sql(t: str, n: str, p: str) -> str:
    parts = " ".join(f"WHEN {_lit(k)} THEN printf({_lit(said)}, {n}, {p})" for k, said in MESSAGES.items())
    return f"CASE {t} {parts} END"


# ------------------------------------------------------------------ alert CTEs used by the report
def vuln_cte() -> str:
    return f"""
vuln AS (
  SELECT r.project_id, r.ecosystem, r.name AS package, r.v AS version, a.cve,
    coalesce(a.severity, 'MEDIUM') AS severity,
    coalesce(a.summary, 'Known vulnerability ' || a.cve || ' found') AS message
  FROM (SELECT *, split_part(replace(version, '=', ''), ',', 1) AS v FROM resolved) r
  JOIN advisories_t a ON a.ecosystem = r.ecosystem AND a.package = r.name
  WHERE {in_range_sql('r.v', 'a.affected_versions')})"""


LICENSE_RISK_SQL = (
    "CASE WHEN {u} LIKE '%GPL%' OR {u} LIKE '%EPL%' OR {u} LIKE '%MPL%' OR {u} LIKE '%CDDL%' THEN 'HIGH' "
    "WHEN {u} LIKE '%MIT%' OR {u} LIKE '%APACHE%' OR {u} LIKE '%BSD%' OR {u} LIKE '%ISC%' OR {u} LIKE '%PUBLIC%' "
    "OR {u} LIKE '%UNLICENSE%' OR {u} LIKE '%WTFPL%' THEN 'LOW' ELSE 'MEDIUM' END"
)
LICENSE_DESC_SQL = (
    "CASE WHEN {u} LIKE '%GPL%' OR {u} LIKE '%EPL%' OR {u} LIKE '%MPL%' OR {u} LIKE '%CDDL%' "
    "THEN 'Copyleft / Restrictive License' "
    "WHEN {u} LIKE '%MIT%' OR {u} LIKE '%APACHE%' OR {u} LIKE '%BSD%' OR {u} LIKE '%ISC%' OR {u} LIKE '%PUBLIC%' "
    "OR {u} LIKE '%UNLICENSE%' OR {u} LIKE '%WTFPL%' THEN 'Permissive License' "
    "WHEN {u} LIKE '%PROPRIETARY%' OR {u} LIKE '%COMMERCIAL%' THEN 'Proprietary / Commercial License' "
    "ELSE 'Unknown / Undefined License' END"
)


def inventory_cte() -> str:
    u = "upper(coalesce(l.license, 'Unknown'))"
    return f"""
inventory AS (
  SELECT r.project_id, r.ecosystem, r.name AS package, coalesce(l.license, 'Unknown') AS license,
    {LICENSE_RISK_SQL.format(u=u)} AS risk, {LICENSE_DESC_SQL.format(u=u)} AS description
  FROM resolved r LEFT JOIN licenses_t l ON l.ecosystem = r.ecosystem AND l.package = r.name)"""


LIC_ALERTS = """
lic_alerts AS (
  SELECT project_id, ecosystem, 'LICENSE_RISK' AS type, package, license, 'HIGH' AS severity,
    'Restrictive copyleft license ''' || license || ''' detected. This might require you to open-source your '
    || 'proprietary code.' AS message
  FROM inventory WHERE risk = 'HIGH'
  UNION ALL
  SELECT project_id, NULL, 'LICENSE_CONFLICT', 'project', NULL, 'CRITICAL',
    'License conflict detected: Project contains both restrictive copyleft (e.g. GPL/EPL) and '
    || 'proprietary/commercial dependencies.'
  FROM inventory GROUP BY project_id
  HAVING bool_or(risk = 'HIGH')
     AND bool_or(lower(license) LIKE '%commercial%' OR lower(license) LIKE '%proprietary%'))"""

UNREG = """
unreg AS (
  SELECT d.project_id, d.ecosystem, d.name AS package, 'CRITICAL' AS severity,
    CASE WHEN d.name LIKE '@%' THEN 'Private scoped package ''' || d.name
         || ''' is NOT registered on the public registry.'
         ELSE 'Private dependency ''' || d.name || ''' is NOT registered on the public registry.' END AS message
  FROM deps d
  WHERE NOT EXISTS (SELECT 1 FROM registry_t g WHERE g.ecosystem = d.ecosystem AND g.package = d.name)
    AND (d.name LIKE '@%' OR d.ecosystem IN ('npm', 'python', 'ruby')))"""


def outdated_cte() -> str:
    inst = "regexp_extract(version, '([0-9]+(?:\\.[0-9]+)*(?:\\.[0-9a-zA-Z\\-]+)?)', 1)"
    return f"""
outd AS (
  SELECT d.project_id, d.ecosystem, d.package, d.installed_version, coalesce(l.latest, '0.0.0') AS latest_version,
    'Package ''' || d.package || ''' is outdated (installed: ' || d.installed_version || ', latest: '
      || coalesce(l.latest, '0.0.0') || '). Consider upgrading.' AS message
  FROM (SELECT project_id, ecosystem, name AS package,
          CASE WHEN version IS NULL OR version = '' OR lower(version) IN ('latest', 'transitive', 'unknown')
               THEN '0.0.0' WHEN {inst} <> '' THEN {inst} ELSE '0.0.0' END AS installed_version
        FROM deps) d
  LEFT JOIN latest_t l ON l.ecosystem = d.ecosystem AND l.package = d.package
  WHERE d.installed_version <> '0.0.0' AND coalesce(l.latest, '0.0.0') <> '0.0.0'
    AND {vk('d.installed_version')} < {vk('l.latest')})"""


def typo_alerts_cte() -> str:
    return f"""
typo_alerts AS (
  SELECT r.project_id, r.ecosystem, r.name AS package, t.similar_to, t.technique, t.severity,
    {typo_message_sql('t.technique', 'r.name', 't.similar_to')} AS message
  FROM (SELECT DISTINCT project_id, ecosystem, name FROM resolved) r
  JOIN typo t ON t.ecosystem = r.ecosystem AND t.name = r.name)"""


def all_alerts_ctes() -> list[str]:
    return (
        GRAPH
        + [ADVISORIES, RELEASES, LICENSES, REGISTRY]
        + typo_ctes("SELECT DISTINCT ecosystem, lower(name) AS name FROM resolved")
        + [typo_alerts_cte(), vuln_cte(), inventory_cte(), LIC_ALERTS, UNREG, outdated_cte()]
        + [
            """
paths AS (SELECT project_id, ecosystem, name AS package, array_to_string(path, ' -> ') AS p
          FROM resolved WHERE len(path) > 1)""",
            """
alerts AS (
  SELECT project_id, 'typosquatting' AS category, ecosystem, 'TYPOSQUATTING' AS type, package, severity, message
  FROM typo_alerts
  UNION ALL SELECT project_id, 'vulnerabilities', ecosystem, 'VULNERABILITY', package, severity, message FROM vuln
  UNION ALL SELECT project_id, 'licenses', ecosystem, type, package, severity, message FROM lic_alerts
  UNION ALL SELECT project_id, 'dep_confusion', ecosystem, 'DEPENDENCY_CONFUSION', package, severity, message
  FROM unreg
  UNION ALL SELECT project_id, 'versions', ecosystem, 'OUTDATED_PACKAGE', package, 'LOW', message FROM outd
  UNION ALL SELECT project_id, 'dep_confusion', NULL, 'DEP_CONFUSION_CONFIG', NULL, severity, message
  FROM (""" + CONFIG_EXPECTED_NPM + " UNION ALL " + CONFIG_EXPECTED_PIP + """)
  UNION ALL SELECT project_id, 'secrets', NULL, type, NULL, severity, NULL FROM (""" + secrets_sql() + """)
  UNION ALL SELECT project_id, 'secrets', NULL, type, NULL, severity, NULL FROM (""" + history_sql() + """)
  UNION ALL SELECT project_id, 'pipeline', NULL, 'PIPELINE_RISK', NULL, severity, """ + pipeline_message_sql() + """
  FROM (""" + pipeline_sql() + """))""",
            """
enriched AS (
  SELECT a.project_id, a.category, a.type, a.package, a.severity,
    p.p IS NOT NULL AS is_transitive, p.p AS dependency_path,
    CASE WHEN p.p IS NOT NULL THEN a.message || ' (Transitive dependency path: ' || p.p || ')'
         ELSE a.message END AS message
  FROM alerts a LEFT JOIN paths p
    ON p.project_id = a.project_id AND p.ecosystem = a.ecosystem AND p.package = a.package)""",
            """
summary AS (
  SELECT project_id,
    CAST(sum(is_dep) AS BIGINT) AS total_dependencies,
    CAST(sum(CASE WHEN category = 'vulnerabilities' THEN 1 ELSE 0 END) AS BIGINT) AS vulnerabilities_found,
    CAST(sum(CASE WHEN category = 'typosquatting' THEN 1 ELSE 0 END) AS BIGINT) AS typosquatting_alerts,
    CAST(sum(CASE WHEN category = 'secrets' THEN 1 ELSE 0 END) AS BIGINT) AS secrets_found,
    CAST(sum(CASE WHEN category = 'pipeline' THEN 1 ELSE 0 END) AS BIGINT) AS pipeline_issues,
    CAST(sum(CASE WHEN category = 'licenses' THEN 1 ELSE 0 END) AS BIGINT) AS licenses_found,
    CAST(sum(CASE WHEN category = 'dep_confusion' THEN 1 ELSE 0 END) AS BIGINT) AS dep_confusion_issues,
    CAST(sum(CASE WHEN category = 'versions' THEN 1 ELSE 0 END) AS BIGINT) AS versions_outdated,
    CAST(sum(CASE WHEN category IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS total_issues,
    CAST(sum(CASE WHEN sev = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS n_critical,
    CAST(sum(CASE WHEN sev = 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
    CAST(sum(CASE WHEN sev = 'MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS n_medium,
    CAST(sum(CASE WHEN sev = 'LOW' THEN 1 ELSE 0 END) AS BIGINT) AS n_low
  FROM (
    SELECT project_id, NULL AS category, NULL AS sev, 1 AS is_dep FROM deps
    UNION ALL
    SELECT project_id, category,
      CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(severity) ELSE 'MEDIUM' END,
      0 FROM alerts) u
  GROUP BY project_id)""",
        ]
    )


# ------------------------------------------------------------------ text fixtures
PIPELINE_FILES = """
pipe_files AS (
  SELECT p_partkey AS project_id,
    CASE p_partkey % 5 WHEN 0 THEN '.github/workflows/ci.yml' WHEN 1 THEN '.gitlab-ci.yml'
      WHEN 2 THEN '.circleci/config.yml' WHEN 3 THEN 'ci/deploy/build.yaml' ELSE 'docs/workflows/notes.yml' END
      AS path,
    'name: build' || chr(10) || 'on: [push]' || chr(10) || 'jobs:' || chr(10) || '  build:' || chr(10)
    || '    env:' || chr(10)
    || CASE WHEN p_partkey % 2 = 0 THEN '      API_TOKEN: "' || substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 12) || '"'
            ELSE '      API_TOKEN: ${{ secrets.API_TOKEN }}' END || chr(10)
    || '    steps:' || chr(10)
    || '      - uses: ' || replace(lower(p_brand), '#', '') || '/' || base || '@'
    || CASE p_partkey % 4 WHEN 0 THEN sha1(CAST(p_partkey AS VARCHAR)) WHEN 1 THEN 'v4' WHEN 2 THEN 'master'
            ELSE 'v' || sha1(CAST(p_partkey AS VARCHAR)) END || chr(10)
    || CASE p_partkey % 3
         WHEN 0 THEN '      - run: curl -sSL https://get.' || base || '.example.com/install.sh | bash'
         WHEN 1 THEN '      - run: wget -q -O- https://dl.example.com/' || base || ' --post-data=$GITHUB_TOKEN'
         ELSE '      - run: make test' END || chr(10) AS content
  FROM packages)"""


def lines_cte(name: str, src: str) -> str:
    """files(project_id, path, content) -> project_id, path, line, text (trailing line end ignored)."""
    return f"""
{name} AS (
  SELECT project_id, path, CAST(generate_subscripts(arr, 1) AS INTEGER) AS line, unnest(arr) AS text
  FROM (SELECT project_id, path,
          regexp_split_to_array(regexp_replace(content, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n') AS arr
        FROM {src}))"""


def _scan_union(lines: str, patterns, extra_cols: str, text: str = "text") -> str:
    parts = []
    for p in patterns:
        parts.append(
            f"SELECT {extra_cols}, {_lit(p.name)} AS pattern_name, {_lit(p.severity)} AS severity, "
            f"trim(regexp_extract({text}, {_lit(p.regex)}, 0), ' \t\n\r\x0b\x0c') AS m FROM {lines} "
            f"WHERE regexp_matches({text}, {_lit(p.regex)})"
        )
    return "\nUNION ALL\n".join(parts)


def pipeline_message_sql() -> str:
    from fleetaudit.operators.textscan import PIPELINE_PATTERNS

    cases = " ".join(f"WHEN {_lit(p.name)} THEN {_lit(p.message)}" for p in PIPELINE_PATTERNS)
    return f"CASE pattern_name {cases} END"


def pipeline_sql() -> str:
    from fleetaudit.operators.textscan import PIPELINE_PATTERNS

    pats = [p for p in PIPELINE_PATTERNS if p.name != "UNPINNED_ACTION"]
    body = _scan_union("pipe_lines", pats, "project_id, path AS file, line")
    unpinned = (
        "SELECT project_id, path AS file, line, 'UNPINNED_ACTION' AS pattern_name, 'MEDIUM' AS severity, m FROM ("
        "SELECT *, regexp_extract(text, 'uses:\\s*[a-zA-Z0-9\\-_]+/[a-zA-Z0-9\\-_]+@([a-zA-Z0-9\\-_.]+)', 0) AS m, "
        "regexp_extract(text, 'uses:\\s*[a-zA-Z0-9\\-_]+/[a-zA-Z0-9\\-_]+@(.*)$', 1) AS after "
        "FROM pipe_lines) WHERE m <> '' AND NOT regexp_matches(after, '^v?[0-9a-f]{40}([^A-Za-z0-9_]|$)')"
    )
    sel = (
        "pipe_sel AS (SELECT * FROM pipe_files WHERE ((path LIKE '.github/workflows/%' OR path LIKE '.gitlab/%' "
        "OR path LIKE '.circleci/%' OR path LIKE 'ci/%') AND (path LIKE '%.yml' OR path LIKE '%.yaml')) "
        "OR path IN ('.gitlab-ci.yml', '.gitlab-ci.yaml', 'Jenkinsfile', 'travis.yml', 'appveyor.yml'))"
    )
    return (
        with_(PACKAGES, PIPELINE_FILES, sel, lines_cte("pipe_lines", "pipe_sel"))
        + f"\nSELECT project_id, file, line, pattern_name, severity, 'Match: ''' || m || '''' AS description FROM (\n"
        + body + "\nUNION ALL\n" + unpinned + ")"
    )


SOURCE_FILES = """
src_files AS (
  SELECT doc_id % 100 AS project_id, source || '/doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
    text AS content FROM documents)"""


def secrets_sql() -> str:
    from fleetaudit.operators.textscan import SECRET_PATTERNS

    body = _scan_union("src_lines", SECRET_PATTERNS, "project_id, path AS file, line")
    sel = ("src_sel AS (SELECT * FROM src_files WHERE NOT regexp_matches(path, "
           "'(^|/)(\\.git|tests|test|node_modules|__pycache__)/') AND NOT contains(content, chr(0)))")
    return (
        with_(SOURCE_FILES, sel, lines_cte("src_lines", "src_sel"))
        + f"\nSELECT project_id, pattern_name AS type, file, line, severity FROM (\n{body})"
    )


def history_sql() -> str:
    from fleetaudit.operators.textscan import HISTORY_COMMITS, SECRET_PATTERNS

    commits = f"""
commits AS (
  SELECT doc_id % 10 AS project_id, doc_id,
    dense_rank() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id DESC) AS rk
  FROM documents),
hist_files AS (
  SELECT d.doc_id % 10 AS project_id, sha1(CAST(d.doc_id AS VARCHAR)) AS commit,
    d.source || '/doc_' || CAST(d.doc_id AS VARCHAR) || '.txt' AS path, d.text
  FROM documents d JOIN commits c ON c.doc_id = d.doc_id WHERE c.rk <= {HISTORY_COMMITS}),
hist_lines AS (
  SELECT project_id, commit, path, CAST(generate_subscripts(arr, 1) AS INTEGER) AS line, unnest(arr) AS text
  FROM (SELECT project_id, commit, path, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS arr FROM hist_files))"""
    body = _scan_union("hist_lines", SECRET_PATTERNS, "project_id, commit, path AS file, line")
    return with_(commits) + f"\nSELECT project_id, pattern_name AS type, commit, file, line, severity FROM (\n{body})"


CONFIG_EXPECTED_NPM = """
SELECT s_suppkey AS project_id, '.npmrc' AS file, 'LOW' AS severity,
  'Scoped registry configured for @corp' || CAST(s_suppkey AS VARCHAR) || ': https://pkgs.supplier'
  || CAST(s_suppkey AS VARCHAR) || '.example.com/npm/. Ensure the scope is locked internally.' AS message
FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL
SELECT s_suppkey, '.npmrc', 'LOW',
  'Scoped registry configured for @team: https://pkgs.supplier' || CAST(s_suppkey AS VARCHAR)
  || '.example.com/team/. Ensure the scope is locked internally.'
FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL
SELECT s_suppkey, '.npmrc', 'MEDIUM',
  'Default npm registry overridden to: https://pkgs.supplier' || CAST(s_suppkey AS VARCHAR) || '.example.com/npm/.'
FROM supplier WHERE s_suppkey % 3 = 1"""

CONFIG_EXPECTED_PIP = """
SELECT s_suppkey AS project_id, CASE WHEN s_suppkey % 5 = 0 THEN 'pip.ini' ELSE 'pip.conf' END AS file,
  'HIGH' AS severity,
  'Multiple index URLs configured using extra-index-url: https://pkgs.supplier' || CAST(s_suppkey AS VARCHAR)
  || '.example.com/simple.' AS message
FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'pip.ini' ELSE 'pip.conf' END, 'HIGH',
  'Multiple index URLs configured using extra-index-url: https://old.example.com/simple.'
FROM supplier WHERE s_suppkey % 4 = 0"""


def oracle_sql() -> dict[str, str]:
    dep_cols = "project_id, ecosystem, pos, name, version, dep_type, scope, is_dev, is_optional"
    typo_decl = typo_ctes("SELECT DISTINCT ecosystem, lower(name) AS name FROM deps")
    typo_sel = "SELECT ecosystem, name, similar_to, technique, confidence, severity FROM typo"
    q: dict[str, str] = {}
    for key, eco in [("parse_requirements", "python"), ("parse_package_json", "npm"), ("parse_gemfile", "ruby"),
                     ("parse_pom", "maven")]:
        q[key] = with_(*BASE) + f"\nSELECT {dep_cols} FROM deps WHERE ecosystem = '{eco}'"
    q["manifest_dispatch"] = with_(*BASE) + """
SELECT project_id, CASE ecosystem WHEN 'python' THEN 'requirements.txt' WHEN 'npm' THEN 'package.json'
  WHEN 'ruby' THEN 'Gemfile' ELSE 'pom.xml' END AS path, ecosystem, count(*) AS n_deps
FROM deps GROUP BY ALL"""
    q["installed_npm"] = with_(PACKAGES, DEPS, EDGES) + """,
inst AS (
  SELECT d.project_id, e.child AS name, min(d.pk) AS pk
  FROM deps d JOIN edges e ON e.ecosystem = d.ecosystem AND e.parent = d.name
  WHERE d.ecosystem = 'npm' GROUP BY ALL)
SELECT project_id, lower(name) AS name, '1.' || CAST(pk % 10 AS VARCHAR) || '.0' AS version, 'transitive' AS dep_type
FROM inst WHERE pk % 11 <> 0"""
    q["closure_depth"] = with_(*GRAPH, recursive=True) + (
        "\nSELECT project_id, ecosystem, name, version, is_direct, depth FROM resolved")
    q["depth_compat"] = with_(*GRAPH, recursive=True) + """
SELECT r.project_id, r.ecosystem, r.name, r.depth,
  CASE WHEN r.is_direct AND EXISTS (
    SELECT 1 FROM deps p JOIN edges e ON e.ecosystem = p.ecosystem AND e.parent = p.name
    WHERE p.project_id = r.project_id AND p.ecosystem = r.ecosystem AND e.child = r.name
      AND p.name <> r.name
      AND p.pos < (SELECT d.pos FROM deps d WHERE d.project_id = r.project_id AND d.ecosystem = r.ecosystem
                   AND d.name = r.name))
  THEN 1 ELSE r.depth END AS depth_compat
FROM resolved r"""
    q["shortest_path"] = with_(*GRAPH, recursive=True) + (
        "\nSELECT project_id, ecosystem, name, array_to_string(path, ' -> ') AS dependency_path FROM resolved "
        "WHERE len(path) > 1")
    q["graph_stats"] = with_(*GRAPH, recursive=True) + """,
pe AS (SELECT r.project_id, r.ecosystem, e.parent, e.child FROM resolved r
       JOIN edges e ON e.ecosystem = r.ecosystem AND e.parent = r.name),
indeg AS (SELECT project_id, ecosystem, child, count(DISTINCT parent) AS n FROM pe GROUP BY ALL),
top AS (SELECT project_id, ecosystem, min({'neg': -n, 'c': child}) AS t FROM indeg GROUP BY ALL),
base AS (SELECT project_id, ecosystem, count(*) AS total_packages,
           CAST(count_if(is_direct) AS BIGINT) AS direct_dependencies,
           CAST(count_if(NOT is_direct) AS BIGINT) AS transitive_dependencies, max(depth) AS max_depth
         FROM resolved GROUP BY ALL)
SELECT b.*, t.t.c AS most_depended_on, coalesce(-t.t.neg, 0) AS dependents_count,
  CAST(0 AS BIGINT) AS circular_dependencies -- the derived edges go from smaller to larger keys only
FROM base b LEFT JOIN top t ON t.project_id = b.project_id AND t.ecosystem = b.ecosystem"""
    q["blast_radius"] = with_(*GRAPH, ADVISORIES, recursive=True) + """
SELECT r.ecosystem, r.name AS package, count(DISTINCT r.project_id) AS n_projects,
  CAST(count_if(r.is_direct) AS BIGINT) AS n_direct, CAST(count_if(NOT r.is_direct) AS BIGINT) AS n_transitive,
  count(DISTINCT CASE WHEN NOT r.is_direct THEN r.path[1] END) AS n_entry_packages
FROM resolved r WHERE EXISTS (SELECT 1 FROM advisories_t a WHERE a.ecosystem = r.ecosystem AND a.package = r.name)
GROUP BY ALL"""
    q["children_counts"] = with_(PACKAGES, EDGES) + (
        "\nSELECT ecosystem, parent, count(DISTINCT child) AS n_children FROM edges GROUP BY ALL")
    q["last_declaration"] = with_(*BASE) + """
SELECT project_id, ecosystem, name, version, coalesce(dep_type, 'direct') AS dep_type, pos AS first_pos,
  CAST(1 AS BIGINT) AS n_declarations FROM deps"""
    q["declared_count"] = with_(*BASE) + "\nSELECT project_id, count(*) AS total_dependencies FROM deps GROUP BY ALL"
    q["vulnerable_deps"] = with_(*GRAPH, ADVISORIES, vuln_cte(), recursive=True) + "\nSELECT * FROM vuln"
    q["latest_release"] = with_(PACKAGES, RELEASES) + "\nSELECT ecosystem, package, latest FROM latest_t"
    q["outdated_deps"] = with_(*BASE, RELEASES, outdated_cte()) + (
        "\nSELECT project_id, ecosystem, package, installed_version, latest_version, message FROM outd")
    q["typo_candidates"] = with_(*BASE, *typo_decl) + "\n" + typo_sel
    for key, techs in [
        ("typo_separator", ["separator_confusion"]), ("typo_homoglyph", ["homoglyph"]),
        ("typo_swap", ["character_swap"]), ("typo_repeat", ["repeated_character"]),
        ("typo_suffix", ["version_suffix"]), ("typo_combo", ["combosquatting"]),
        ("typo_edit", ["levenshtein_distance_1", "levenshtein_distance_2"]),
    ]:
        inlist = ", ".join(_lit(t) for t in techs)
        q[key] = with_(*BASE, *typo_decl) + f"\n{typo_sel} WHERE technique IN ({inlist})"
    q["typosquat_alerts"] = with_(
        *GRAPH, *typo_ctes("SELECT DISTINCT ecosystem, lower(name) AS name FROM resolved"), typo_alerts_cte(),
        recursive=True,
    ) + "\nSELECT project_id, ecosystem, package, similar_to, technique, severity, message FROM typo_alerts"
    q["license_inventory"] = with_(*GRAPH, LICENSES, inventory_cte(), recursive=True) + "\nSELECT * FROM inventory"
    q["license_alerts"] = with_(*GRAPH, LICENSES, inventory_cte(), LIC_ALERTS, recursive=True) + (
        "\nSELECT * FROM lic_alerts")
    u = "upper(text)"
    q["license_risk_docs"] = with_(SOURCE_FILES, lines_cte("src_lines", "src_files")) + f"""
SELECT project_id, path, line, {LICENSE_RISK_SQL.format(u=u)} AS risk, {LICENSE_DESC_SQL.format(u=u)} AS description
FROM src_lines WHERE regexp_matches(text, '(?i)licen[sc]e')"""
    q["unregistered_deps"] = with_(*BASE, REGISTRY, UNREG) + "\nSELECT * FROM unreg"
    q["npm_config_alerts"] = CONFIG_EXPECTED_NPM.strip()
    q["pip_config_alerts"] = CONFIG_EXPECTED_PIP.strip()
    q["pipeline_alerts"] = pipeline_sql()
    q["secret_alerts"] = secrets_sql()
    q["history_secrets"] = history_sql()
    report = with_(*all_alerts_ctes(), recursive=True)
    q["enriched_alerts"] = report + (
        "\nSELECT project_id, category, type, package, severity, is_transitive, dependency_path, message "
        "FROM enriched")
    score = "greatest(0, 100 - 15 * n_critical - 8 * n_high - 3 * n_medium - n_low)"
    q["project_summary"] = report + f"""
SELECT *, CAST({score} AS INTEGER) AS security_score,
  CASE WHEN {score} >= 80 THEN 'SECURE' WHEN {score} >= 50 THEN 'WARNING' ELSE 'VULNERABLE' END AS band
FROM summary"""
    q["recommendations"] = report + """
SELECT project_id, array_to_string(list_filter([
  CASE WHEN vulnerabilities_found > 0 THEN 'Update ' || vulnerabilities_found
    || ' vulnerable packages to latest patched versions' END,
  CASE WHEN typosquatting_alerts > 0 THEN 'Review and remove potentially malicious packages flagged for typosquatting'
    END,
  CASE WHEN secrets_found > 0 THEN 'Rotate exposed credentials and implement secret scanning in CI/CD' END,
  CASE WHEN licenses_found > 0 THEN 'Review and resolve restrictive copyleft license risks and conflicts' END,
  CASE WHEN dep_confusion_issues > 0 THEN 'Secure private package registers, scope scopes, or register placeholders '
    || 'publicly to prevent dependency confusion' END,
  CASE WHEN pipeline_issues > 0 THEN 'Pin third-party Actions to full commit SHAs and remove dangerous command lines '
    || 'from CI/CD' END,
  CASE WHEN versions_outdated > 0 THEN 'Upgrade ' || versions_outdated || ' outdated packages to their latest versions'
    END], lambda x: x IS NOT NULL), ' | ') AS recommendations
FROM summary"""
    ev = """
ev AS (
  SELECT user_id AS project_id, ts, event_id,
    CASE event_type WHEN 'error' THEN 'vulnerabilities' WHEN 'signup' THEN 'dep_confusion'
      WHEN 'click' THEN 'typosquatting' WHEN 'view' THEN 'pipeline' WHEN 'purchase' THEN 'versions' END AS category,
    CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'signup' THEN 'CRITICAL' WHEN 'click' THEN 'MEDIUM'
      WHEN 'view' THEN 'MEDIUM' WHEN 'purchase' THEN 'LOW' END AS severity,
    'pkg-' || CAST(event_id % 97 AS VARCHAR) AS package
  FROM events)"""
    q["stream_alert_counts"] = with_(ev) + """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, category, count(*) AS n_alerts
FROM ev GROUP BY ALL"""
    q["stream_dedup"] = with_(ev) + "\nSELECT DISTINCT project_id, category, package, severity FROM ev"
    q["stream_score"] = with_(ev) + f"""
SELECT *, CAST({score} AS INTEGER) AS security_score,
  CASE WHEN {score} >= 80 THEN 'SECURE' WHEN {score} >= 50 THEN 'WARNING' ELSE 'VULNERABLE' END AS band
FROM (SELECT project_id, CAST(count_if(severity = 'CRITICAL') AS BIGINT) AS n_critical,
        CAST(count_if(severity = 'HIGH') AS BIGINT) AS n_high, CAST(count_if(severity = 'MEDIUM') AS BIGINT) AS n_medium,
        CAST(count_if(severity = 'LOW') AS BIGINT) AS n_low FROM ev GROUP BY project_id)"""
    q["stream_outdated"] = q["outdated_deps"]
    q["quarantined_manifests"] = with_(*BASE) + """
SELECT DISTINCT project_id, CASE ecosystem WHEN 'npm' THEN 'package.json' ELSE 'pom.xml' END AS path,
  CASE ecosystem WHEN 'npm' THEN 'malformed JSON' ELSE 'malformed XML' END AS reason
FROM deps WHERE ecosystem IN ('npm', 'maven') AND project_id % 7 = 0"""
    pe = """
pe AS (SELECT r.project_id, r.ecosystem, e.parent, e.child FROM resolved r
       JOIN edges e ON e.ecosystem = r.ecosystem AND e.parent = r.name)"""
    q["cycle_members"] = with_(PACKAGES, EDGES, """
cedges AS (
  SELECT * FROM edges
  UNION
  SELECT ecosystem, child AS parent, parent AS child FROM edges
  WHERE child LIKE 'internal-%' AND CAST(regexp_extract(parent, '([0-9]+)$', 1) AS BIGINT) % 5 = 0)""", """
reach(ecosystem, src, dst) AS (
  SELECT ecosystem, parent, child FROM cedges
  UNION
  SELECT r.ecosystem, r.src, e.child FROM reach r JOIN cedges e ON e.ecosystem = r.ecosystem AND e.parent = r.dst),
inner_edges AS (
  SELECT c.* FROM cedges c JOIN reach r ON r.ecosystem = c.ecosystem AND r.src = c.child AND r.dst = c.parent
  WHERE c.parent <> c.child),
walk(ecosystem, root, node, path) AS (
  SELECT DISTINCT ecosystem, child, child, [child] FROM inner_edges
  UNION ALL
  SELECT w.ecosystem, w.root, e.child, list_append(w.path, e.child)
  FROM walk w JOIN inner_edges e ON e.ecosystem = w.ecosystem AND e.parent = w.node
  WHERE NOT list_contains(w.path, e.child)),
best AS (SELECT ecosystem, root, node, min({'n': len(path), 'p': path}).p AS path FROM walk GROUP BY ALL),
loops AS (
  SELECT b.ecosystem, b.path, list_position(b.path, list_min(b.path)) AS k
  FROM best b JOIN inner_edges e ON e.ecosystem = b.ecosystem AND e.child = b.root AND e.parent = b.node),
turned AS (
  SELECT DISTINCT ecosystem, list_concat(list_concat(list_slice(path, k, len(path)), list_slice(path, 1, k - 1)), [path[k]]) AS cycle FROM loops)""", recursive=True) + """
SELECT ecosystem, array_to_string(cycle, ' -> ') AS cycle, CAST(len(cycle) - 1 AS INTEGER) AS length FROM turned
UNION ALL
SELECT ecosystem, parent || ' -> ' || child, 1 FROM cedges WHERE parent = child"""
    cycle_reach = with_(PACKAGES, EDGES, """
cedges AS (
  SELECT * FROM edges
  UNION
  SELECT ecosystem, child AS parent, parent AS child FROM edges
  WHERE child LIKE 'internal-%' AND CAST(regexp_extract(parent, '([0-9]+)$', 1) AS BIGINT) % 5 = 0)""", """
reach(ecosystem, src, dst) AS (
  SELECT ecosystem, parent, child FROM cedges
  UNION
  SELECT r.ecosystem, r.src, e.child FROM reach r JOIN cedges e ON e.ecosystem = r.ecosystem AND e.parent = r.dst)""",
        recursive=True)
    q["cycle_nodes"] = cycle_reach + """
SELECT DISTINCT ecosystem, src AS name FROM reach WHERE src = dst"""
    q["cycle_groups"] = cycle_reach + """
SELECT r.ecosystem, min(r.dst) AS component, count(*) AS size, r.src AS member
FROM reach r JOIN reach b ON b.ecosystem = r.ecosystem AND b.src = r.dst AND b.dst = r.src
GROUP BY r.ecosystem, r.src"""
    walks = with_(*GRAPH, ADVISORIES, pe, """
dir AS (SELECT project_id, ecosystem, name FROM resolved WHERE is_direct)""", """
up(project_id, ecosystem, name, cur, chain) AS (
  SELECT project_id, ecosystem, name, name, [name] FROM resolved WHERE NOT is_direct
  UNION ALL
  SELECT u.project_id, u.ecosystem, u.name, p.parent, list_append(u.chain, p.parent)
  FROM up u
  JOIN pe p ON p.project_id = u.project_id AND p.ecosystem = u.ecosystem AND p.child = u.cur
  LEFT JOIN dir d ON d.project_id = u.project_id AND d.ecosystem = u.ecosystem AND d.name = u.cur
  WHERE d.name IS NULL AND NOT list_contains(u.chain, p.parent))""", recursive=True)
    q["dependency_chains"] = walks + """
SELECT u.project_id, u.ecosystem, u.name, array_to_string(list_reverse(u.chain), ' -> ') AS chain
FROM up u JOIN dir d ON d.project_id = u.project_id AND d.ecosystem = u.ecosystem AND d.name = u.cur
WHERE len(u.chain) > 1"""
    q["vulnerable_chains"] = walks + """,
led AS (
  SELECT u.project_id, u.ecosystem, u.name, list_reverse(u.chain) AS chain
  FROM up u JOIN dir d ON d.project_id = u.project_id AND d.ecosystem = u.ecosystem AND d.name = u.cur
  UNION ALL SELECT project_id, ecosystem, name, [name] FROM dir)
SELECT project_id, ecosystem, name, n_chains, CAST(rank AS INTEGER) AS rank, array_to_string(chain, ' -> ') AS chain
FROM (
  SELECT *, count(*) OVER (PARTITION BY project_id, ecosystem, name) AS n_chains,
    row_number() OVER (PARTITION BY project_id, ecosystem, name ORDER BY len(chain), chain) AS rank
  FROM led l
  WHERE EXISTS (SELECT 1 FROM advisories_t a WHERE a.ecosystem = l.ecosystem AND a.package = l.name))
WHERE rank <= 3"""
    q["package_list"] = with_(*GRAPH, recursive=True) + """
SELECT row_number() OVER (ORDER BY ecosystem, name) AS position, ecosystem, name
FROM (SELECT DISTINCT ecosystem, name FROM resolved)"""
    q["graph_nodes"] = with_(*GRAPH, pe, recursive=True) + """,
down AS (SELECT project_id, ecosystem, parent AS name, count(DISTINCT child) AS d FROM pe GROUP BY ALL),
up AS (SELECT project_id, ecosystem, child AS name, count(DISTINCT parent) AS u FROM pe GROUP BY ALL)
SELECT r.project_id, r.ecosystem, r.name, r.version, r.dep_type AS type, r.depth, r.is_direct,
  coalesce(down.d, 0) AS n_depends_on, coalesce(up.u, 0) AS n_depended_on_by
FROM resolved r
LEFT JOIN down ON down.project_id = r.project_id AND down.ecosystem = r.ecosystem AND down.name = r.name
LEFT JOIN up ON up.project_id = r.project_id AND up.ecosystem = r.ecosystem AND up.name = r.name"""
    q["tree_view"] = with_(*GRAPH, pe, recursive=True) + """,
kids AS (SELECT project_id, ecosystem, parent AS name, count(DISTINCT child) AS n FROM pe GROUP BY ALL)
SELECT r.project_id, r.ecosystem, r.name, r.depth, coalesce(k.n, 0) AS n_children
FROM resolved r LEFT JOIN kids k ON k.project_id = r.project_id AND k.ecosystem = r.ecosystem AND k.name = r.name
WHERE r.depth < 2"""
    return q
