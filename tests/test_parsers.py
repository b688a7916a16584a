"""Manifest parsers (S1–S6) on the original tool's test cases."""

from pyspark.sql import functions as F

from fleetaudit.sources import manifests as M
from tests.conftest import rows


def _m(spark, path, content, pid=1):
    return spark.createDataFrame([(pid, path, None, content)], "project_id long, path string, ecosystem string, "
                                                              "content string")


def test_requirements(spark):
    txt = "# tools\norjson==3.9.0\n\nduckdb\npolars>=0.20\n"
    out = M.requirements_deps(_m(spark, "requirements.txt", txt)).orderBy("pos").collect()
    assert [(r.pos, r.name, r.version) for r in out] == [(1, "orjson", "3.9.0"), (2, "duckdb", "latest"),
                                                         (3, "polars", "0.20")]


def test_requirements_quirks(spark):
    # spaces before the operator, extras and '!=' give 'latest'; 'a.b==1' gives name 'a'; CRLF lines
    txt = "Foo_Bar >= 1.0\r\npkg[extra]==2\r\nx!=3\r\na.b==1\r\n  spaced==1.0  \r\nrange>=3.2,<4"
    out = M.requirements_deps(_m(spark, "r.txt", txt)).orderBy("pos").collect()
    assert [(r.name, r.version) for r in out] == [
        ("foo_bar", "latest"), ("pkg", "latest"), ("x", "latest"), ("a", "latest"), ("spaced", "1.0"),
        ("range", "3.2,<4"),
    ]


def test_package_json(spark):
    txt = ('{"devDependencies": {"tap": "^18.5.0"}, "version": "0.3.0", '
           '"dependencies": {"Pino": "~8.1.0", "got": "13.0.0"}}')
    out = M.package_json_deps(_m(spark, "package.json", txt)).orderBy("pos").collect()
    assert [(r.name, r.version, r.dep_type, r.is_dev, r.is_optional) for r in out] == [
        ("pino", "~8.1.0", "dependencies", False, False),
        ("got", "13.0.0", "dependencies", False, False),
        ("tap", "^18.5.0", "devDependencies", True, False),
    ]


def test_package_json_four_sections_and_bad_json(spark):
    txt = ('{"optionalDependencies": {"bufferutil": "4.0.8"}, "peerDependencies": {"preact": ">=10"}, '
           '"dependencies": {"preact": "10.19.0"}}')
    out = M.package_json_deps(_m(spark, "package.json", txt)).orderBy("pos").collect()
    assert [(r.name, r.dep_type) for r in out] == [
        ("preact", "dependencies"), ("preact", "peerDependencies"), ("bufferutil", "optionalDependencies")]
    assert M.package_json_deps(_m(spark, "package.json", "{not json")).count() == 0
    # a repeated key keeps its first position and its last value (as a JSON object does)
    dup = '{"dependencies": {"a": "1", "b": "2", "A": "9", "a": "3"}}'
    out = M.package_json_deps(_m(spark, "package.json", dup)).orderBy("pos").collect()
    assert [(r.name, r.version) for r in out] == [("a", "3"), ("b", "2"), ("a", "9")]


def test_gemfile(spark):
    txt = "ruby '3.3.0'\n# gem 'off'\ngem \"hanami\", \"~> 2.1\"\ngem 'oj'\ngem 'falcon', '0.43.0'\n"
    out = M.gemfile_deps(_m(spark, "Gemfile", txt)).orderBy("pos").collect()
    assert [(r.name, r.version, r.dep_type) for r in out] == [
        ("hanami", "~> 2.1", "dependencies"), ("oj", "latest", "dependencies"), ("falcon", "0.43.0", "dependencies")]


def test_pom(spark):
    txt = """<?xml version="1.0"?>
<project xmlns="http://maven.apache.org/POM/4.0.0">
  <properties><guice.release>7.0.0</guice.release></properties>
  <dependencies>
    <dependency><groupId>org.assertj</groupId><artifactId>assertj-core</artifactId><version>3.25.1</version>
      <scope>test</scope></dependency>
    <dependency>
      <groupId>com.google.inject</groupId><artifactId>guice</artifactId>
      <version>${guice.release}</version>
      <exclusions><exclusion><groupId>x</groupId><artifactId>y</artifactId></exclusion></exclusions>
    </dependency>
    <dependency><groupId>a</groupId><artifactId>B</artifactId><version>${missing}</version></dependency>
    <dependency><groupId>only-group</groupId></dependency>
    <!-- <dependency><groupId>old</groupId><artifactId>gone</artifactId></dependency> -->
  </dependencies>
</project>"""
    out = M.pom_deps(_m(spark, "pom.xml", txt)).orderBy("pos").collect()
    assert [(r.name, r.version, r.scope, r.is_dev) for r in out] == [
        ("org.assertj:assertj-core", "3.25.1", "test", True),
        ("com.google.inject:guice", "7.0.0", "compile", False),
        ("a:b", "${missing}", "compile", False),
    ]


def test_classify(spark):
    paths = ["requirements.txt", "package.json", "Gemfile", "x.gemfile", "app.rb", "pom.xml", "lib.pom",
             "setup.cfg", ".txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.e for r in df.select("path", M.classify_manifest(F.col("path")).alias("e")).collect()}
    assert got == {"requirements.txt": "python", "package.json": "npm", "Gemfile": "ruby", "x.gemfile": "ruby",
                   "app.rb": "ruby", "pom.xml": "maven", "lib.pom": "maven", "setup.cfg": None, ".txt": None}


def test_dispatch_and_installed(spark):
    m = spark.createDataFrame(
        [(1, "package.json", '{"dependencies": {"a": "1.0.0"}}'), (2, "setup.cfg", "x")],
        "project_id long, path string, content string",
    )
    files = spark.createDataFrame(
        [(1, "node_modules/Left-Pad/package.json", '{"version": "1.3.0"}'),
         (1, "node_modules/broken/package.json", "{nope"),
         (1, "node_modules/@scope/pkg/package.json", '{"version": "2.0.0"}')],
        "project_id long, path string, content string",
    )
    deps, quarantine = M.parse_manifests(m, files)
    assert rows(deps, "name", "version", "source") == [("a", "1.0.0", "declared"), ("left-pad", "1.3.0", "installed")]
    assert rows(quarantine, "project_id", "path") == [(2, "setup.cfg")]


def test_requirements_agree_with_python_lines(spark):
    """Dialect check: Spark line splitting/strip/regex vs Python text-mode lines + str.strip + re.match."""
    import io
    import random
    import re

    rnd = random.Random(9)
    frags = ["requests", "Django", "a-b_c", "==", ">=", "~=", "<", "2.0", "1.2.3", ",<4", " ", "\t", " ",
             " ", "#", "x", "[extra]", ";python_version>'3'", ".", "-r", "!=", "é"]
    lines = ["".join(rnd.choice(frags) for _ in range(rnd.randint(0, 5))) for _ in range(300)]
    content = rnd.choice(["\n", "\r\n"]).join(lines) + "\n"
    expected = []
    for raw in io.StringIO(content, newline=None):  # universal newlines, like text-mode reading
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        m = re.match(r"^([a-zA-Z0-9\-_]+)(?:[=<>~]+(.*))?", line)
        if m:
            expected.append((m.group(1).lower(), m.group(2) if m.group(2) else "latest"))
    got = [(r.name, r.version) for r in M.requirements_deps(_m(spark, "requirements.txt", content))
           .orderBy("pos").collect()]
    assert got == expected


def test_gemfile_and_pom_agree_with_python(spark):
    """Dialect checks: Gemfile lines vs Python re; pom.xml vs xml.etree on generated documents."""
    import random
    import re
    import xml.etree.ElementTree as ET

    rnd = random.Random(4)
    frags = ["gem", " ", "'", '"', "rails", "Puma", ",", "~> 6.0", ">= 1", "7.1.3", "gemspec", "#", "\t", "x"]
    lines = ["".join(rnd.choice(frags) for _ in range(rnd.randint(0, 8))) for _ in range(300)]
    content = "\n".join(lines) + "\n"
    expected = []
    for raw in content.split("\n"):
        line = raw.strip()
        if not line or line.startswith("#") or not line.startswith("gem"):
            continue
        m = re.match(r"^gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", line)
        if m:
            expected.append((m.group(1).lower(), m.group(2) if m.group(2) else "latest"))
    got = [(r.name, r.version) for r in M.gemfile_deps(_m(spark, "Gemfile", content)).orderBy("pos").collect()]
    assert got == expected

    ns = "http://maven.apache.org/POM/4.0.0"
    docs = []
    for d in range(30):
        props = {f"p{i}": f"{rnd.randint(0, 9)}.{rnd.randint(0, 9)}" for i in range(rnd.randint(0, 3))}
        deps = []
        for j in range(rnd.randint(0, 5)):
            parts = []
            if rnd.random() < 0.9:
                parts.append(f"<groupId>org.g{j}</groupId>")
            if rnd.random() < 0.9:
                parts.append(f"<artifactId> Art{j} </artifactId>")
            r = rnd.random()
            if r < 0.3 and props:
                parts.append("<version>${" + rnd.choice(list(props) + ["missing"]) + "}</version>")
            elif r < 0.7:
                parts.append(f"<version>{rnd.randint(1, 5)}.0</version>")
            if rnd.random() < 0.4:
                parts.append(f"<scope>{rnd.choice(['test', 'provided', 'runtime'])}</scope>")
            deps.append("<dependency>" + "".join(parts) + "</dependency>")
        body = "".join(deps)
        if rnd.random() < 0.3:
            body = f"<dependencyManagement><dependencies>{body}</dependencies></dependencyManagement>"
        prop_xml = "".join(f"<{k}>{v}</{k}>" for k, v in props.items())
        docs.append((d, f'<project xmlns="{ns}"><properties>{prop_xml}</properties><dependencies>{body}'
                        f"</dependencies></project>"))
    expected = []
    for d, text in docs:
        root = ET.fromstring(text)
        q = "{" + ns + "}"
        pe = root.find(f".//{q}properties")
        props = {c.tag.replace(q, ""): (c.text or "").strip() for c in pe} if pe is not None else {}
        for el in root.findall(f".//{q}dependency"):
            g, a = el.find(f"{q}groupId"), el.find(f"{q}artifactId")
            if g is None or a is None:
                continue
            v_el, s_el = el.find(f"{q}version"), el.find(f"{q}scope")
            v = (v_el.text or "").strip() if v_el is not None else "latest"
            if not v:
                v = "latest"
            m = re.match(r"^\$\{(.+)\}$", v)
            if m:
                v = props.get(m.group(1), v)
            scope = (s_el.text or "compile").strip() if s_el is not None else "compile"
            expected.append((d, f"{(g.text or '').strip()}:{(a.text or '').strip()}".lower(), v, scope))
    df = spark.createDataFrame([(d, "pom.xml", None, t) for d, t in docs],
                               "project_id long, path string, ecosystem string, content string")
    got = [(r.project_id, r.name, r.version, r.scope) for r in M.pom_deps(df).orderBy("project_id", "pos").collect()]
    assert got == expected


def test_malformed_manifests_are_quarantined(spark):
    good = ('<project a="1"><dependencies><dependency optional="1"><groupId x="y">g&amp;h</groupId>'
            "<artifactId>b</artifactId><version>1&lt;2</version></dependency><dependency/></dependencies></project>")
    files = [(1, "pom.xml", good), (2, "pom.xml", good[:-12]), (3, "pom.xml", good.replace("</artifactId>", "</x>")),
             (4, "package.json", '{"dependencies": {"a": "1"'), (5, "package.json", "{}"), (6, "notes.md", "x"),
             (7, "pom.xml", None), (8, "package.json", None)]
    deps, bad = M.parse_manifests(spark.createDataFrame(files, "project_id long, path string, content string"))
    assert rows(deps, "project_id", "name", "version") == [(1, "g&h:b", "1<2")]
    assert rows(bad, "project_id", "reason") == [
        (2, "malformed XML"), (3, "malformed XML"), (4, "malformed JSON"), (6, "unsupported path"),
        (7, "malformed XML"), (8, "malformed JSON")]


def test_pom_forms_that_only_an_xml_parser_sees(spark):
    """CDATA, character references, prefixes and comments, against xml.etree."""
    import xml.etree.ElementTree as ET

    body = (
        "<m:dependency><m:groupId><![CDATA[a<b&c]]></m:groupId><m:artifactId>x&#45;y&#x1F600;</m:artifactId><m:version>1&#46;2</m:version></m:dependency>"
        "<m:dependency><m:groupId>g&amp;#46;</m:groupId><m:artifactId>&#38;lt;</m:artifactId><m:version>${v}</m:version><m:scope>test</m:scope></m:dependency>"
        "<x:dependency><x:groupId>other</x:groupId><x:artifactId>ns</x:artifactId></x:dependency>"
        "<!-- <m:dependency><![CDATA[ --><m:dependency><m:groupId><![CDATA[<!-- no comment -->]]></m:groupId><m:artifactId>z</m:artifactId></m:dependency>"
    )
    pom = ('<?xml version="1.0"?>\n<m:project xmlns:m="urn:m" xmlns:x="urn:x"><m:properties><m:v>3<![CDATA[.]]>1&#48;</m:v></m:properties>'
           f"<m:dependencies>{body}</m:dependencies></m:project>")
    root, ns = ET.fromstring(pom), "{urn:m}"
    want = []
    for d in root.iter(ns + "dependency"):
        v = d.findtext(ns + "version", "latest")
        want.append(((d.findtext(ns + "groupId") + ":" + d.findtext(ns + "artifactId")).lower(), root.findtext(f".//{ns}v") if v == "${v}" else v))
    df = spark.createDataFrame([(1, "pom.xml", "maven", pom)], "project_id long, path string, ecosystem string, content string")
    got = [(r.name, r.version) for r in M.pom_deps(df).orderBy("pos").collect()]
    assert got == want and len(got) == 3
