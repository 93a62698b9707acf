"""Facts from the text of files: documents, container files, settings, protocols, manifests, structured data."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import resolved
from graphloom.storage import ship_package

SHELLS = ("sh", "bash", "shell", "console", "zsh")
LINK = r"(!?)\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
PATH = r"(?:[A-Za-z0-9_.\-]+/)+[A-Za-z0-9_\-]+\.[A-Za-z0-9]+"


def lines_of(files: DataFrame) -> DataFrame:
    """files: path, content. path, line (from 1), text of each line."""
    rows = files.where("content IS NOT NULL").select("path", F.posexplode(F.split("content", "\r?\n")).alias("pos", "text"))
    return rows.select("path", (F.col("pos") + 1).cast("long").alias("line"), "text")


def fenced(lines: DataFrame) -> DataFrame:
    """lines with fence (the line opens or closes one), inside (it stands between) and language (of the fence it is in)."""
    fence = F.ltrim("text").startswith("```")
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("fence", fence).withColumn("_before", F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)))
    inside = ~F.col("fence") & (F.pmod("_before", F.lit(2)) == 1)
    opens = F.col("fence") & (F.pmod("_before", F.lit(2)) == 0)
    language = F.last(F.when(opens, F.lower(F.regexp_extract("text", r"^\s*```\s*([A-Za-z0-9_+\-]*)", 1))), ignorenulls=True).over(upto)
    return out.withColumns({"inside": inside, "opens": opens, "language": F.when(inside | opens, language)}).drop("_before")


def headings(files: DataFrame) -> DataFrame:
    """path, line, level, title of headings outside of fences."""
    rows = fenced(lines_of(files)).where("NOT fence AND NOT inside")
    found = rows.where(F.col("text").rlike(r"^#{1,6}\s+\S"))
    return found.select("path", "line", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("text", r"^#+\s+(.*?)[\s#]*$", 1)).alias("title"))


def links(files: DataFrame) -> DataFrame:
    """path, line, kind (link, image), label, target of links outside of fences, and resolved: the file that a relative one names."""
    rows = fenced(lines_of(files)).where("NOT fence AND NOT inside")
    found = rows.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(0))).alias("link"))
    part = lambda k: F.regexp_extract("link", LINK, k)
    target = part(3)
    file = F.regexp_replace(target, r"[#?].*$", "")
    relative = (file != "") & ~target.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:|//|#)")
    named = found.select("path", "line", F.when(part(1) == "!", "image").otherwise("link").alias("kind"), part(2).alias("label"), target.alias("target"), F.when(relative, file).alias("_file"))
    return named.withColumn("resolved", F.when(F.col("_file").isNotNull(), resolved(F.col("path"), F.col("_file")))).drop("_file")


def fences(files: DataFrame) -> DataFrame:
    """path, line, language of each opening fence."""
    return fenced(lines_of(files)).where("opens").select("path", "line", "language")


def commands(files: DataFrame) -> DataFrame:
    """path, line, command of the lines in shell fences; comments are none, and a leading "$ " goes."""
    rows = fenced(lines_of(files)).where(F.col("inside") & F.col("language").isin(*SHELLS))
    command = F.trim(F.regexp_replace("text", r"^\s*\$ ", ""))
    return rows.select("path", "line", command.alias("command")).where((F.col("command") != "") & ~F.col("command").startswith("#"))


def path_references(files: DataFrame) -> DataFrame:
    """path, line, reference: words that look like a path of a file, outside of fences and links."""
    rows = fenced(lines_of(files)).where("NOT fence AND NOT inside")
    text = F.regexp_replace(F.regexp_replace("text", LINK, " "), r"[A-Za-z][A-Za-z0-9+.\-]*://\S*", " ")
    return rows.select("path", "line", F.explode(F.regexp_extract_all(text, F.lit(PATH), F.lit(0))).alias("reference")).distinct()


def container_steps(files: DataFrame) -> DataFrame:
    """path, step, instruction, arguments, stage (from 1), stage_name of container files; lines ending in a backslash go on."""
    joined = files.select("path", F.regexp_replace("content", r"\\[ \t]*\r?\n", " ").alias("content"))
    rows = lines_of(joined).where(F.col("text").rlike(r"^\s*[A-Za-z]+(\s|$)") & ~F.col("text").rlike(r"^\s*#"))
    rows = rows.select("path", "line", F.upper(F.regexp_extract("text", r"^\s*([A-Za-z]+)", 1)).alias("instruction"), F.trim(F.regexp_extract("text", r"^\s*[A-Za-z]+(.*)$", 1)).alias("arguments"))
    upto = Window.partitionBy("path").orderBy("line")
    start = F.col("instruction") == "FROM"
    name = F.when(start, F.coalesce(F.nullif(F.regexp_extract("arguments", r"(?i)\sAS\s+(\S+)\s*$", 1), F.lit("")), F.lit("")))
    return rows.select(
        "path", F.row_number().over(upto).alias("step"), "instruction", "arguments", F.sum(start.cast("int")).over(upto).alias("stage"), F.last(name, ignorenulls=True).over(upto).alias("stage_name")
    )


def assignments(files: DataFrame) -> DataFrame:
    """path, line, key, value, placeholders (sorted names of ${name} or $name) of settings files; "export" and quotes go."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.\-]*)\s*[=:]\s*(.*?)\s*$"
    rows = lines_of(files).where(F.col("text").rlike(pattern) & ~F.col("text").rlike(r"^\s*[#!;]"))
    value = F.regexp_replace(F.regexp_extract("text", pattern, 2), r"^([\"'])(.*)\1$", "$2")
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(value, F.lit(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))))
    return rows.select("path", "line", F.regexp_extract("text", pattern, 1).alias("key"), value.alias("value"), names.alias("placeholders"))


def protocol_calls(files: DataFrame) -> DataFrame:
    """path, line, service, rpc of protocol files; a call counts inside the braces of its service."""
    rows = lines_of(files).withColumn("text", F.regexp_replace("text", "//.*$", ""))
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    upto = Window.partitionBy("path").orderBy("line")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("depth", F.coalesce(F.sum(count("{") - count("}")).over(before), F.lit(0)))
    top = F.regexp_extract("text", r"^\s*(service|message|enum)\s+([A-Za-z_][A-Za-z0-9_]*)", 2)
    kind = F.regexp_extract("text", r"^\s*(service|message|enum)\s+[A-Za-z_]", 1)
    opened = F.when((F.col("depth") == 0) & (top != ""), F.struct(kind.alias("kind"), top.alias("name")))
    rows = rows.withColumn("owner", F.last(opened, ignorenulls=True).over(upto))
    call = F.regexp_extract("text", r"^\s*rpc\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1)
    return rows.where((F.col("owner.kind") == "service") & (F.col("depth") >= 1) & (call != "")).select("path", "line", F.col("owner.name").alias("service"), call.alias("rpc"))


def requirements(files: DataFrame) -> DataFrame:
    """path, line, package (lower case, dashes), specifier of requirement files; comments, options and extras go."""
    pattern = r"^\s*([A-Za-z0-9][A-Za-z0-9._\-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)"
    rows = lines_of(files).where(F.col("text").rlike(r"^\s*[A-Za-z0-9]"))
    package = F.regexp_replace(F.lower(F.regexp_extract("text", pattern, 1)), "[_.]+", "-")
    return rows.select("path", "line", package.alias("package"), F.trim(F.regexp_extract("text", pattern, 2)).alias("specifier"))


def go_modules(files: DataFrame) -> DataFrame:
    """path, module, package, version, indirect of go.mod files, whether required in a block or on a line."""
    rows = lines_of(files)
    upto = Window.partitionBy("path").orderBy("line")
    begins, ends = F.col("text").rlike(r"^\s*require\s*\("), F.col("text").rlike(r"^\s*\)")
    state = F.last(F.when(begins, F.lit(True)).when(ends | F.col("text").rlike(r"^\s*[a-z]+\s*\("), F.lit(False)), ignorenulls=True).over(upto)
    module = F.max(F.nullif(F.regexp_extract("text", r"^\s*module\s+(\S+)", 1), F.lit(""))).over(Window.partitionBy("path"))
    rows = rows.withColumns({"_in": F.coalesce(state, F.lit(False)) & ~begins, "module": module})
    pattern = r"^\s*(?:require\s+)?([^\s()]+)\s+(v[^\s]+)"
    one = F.col("text").rlike(r"^\s*require\s+[^\s(]")
    found = rows.where((F.col("_in") | one) & F.col("text").rlike(pattern))
    return found.select("path", "module", F.regexp_extract("text", pattern, 1).alias("package"), F.regexp_extract("text", pattern, 2).alias("version"), F.col("text").rlike(r"//\s*indirect").alias("indirect"))


def gradle_dependencies(files: DataFrame) -> DataFrame:
    """path, line, scope, package of build.gradle files: implementation "group:name:version" and its kind."""
    pattern = r"^\s*(api|implementation|compileOnly|runtimeOnly|testImplementation|kapt|annotationProcessor)[\s(]+[\"']([^\"':]+:[^\"':]+)"
    rows = lines_of(files).where(F.col("text").rlike(pattern))
    return rows.select("path", "line", F.regexp_extract("text", pattern, 1).alias("scope"), F.regexp_extract("text", pattern, 2).alias("package"))


def _flattened(value: Any, path: str) -> Iterator[tuple[str, str, str | None]]:
    if isinstance(value, dict):
        yield path, "Object", None
        for k, v in value.items():
            yield from _flattened(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        yield path, "Array", None
        for i, v in enumerate(value):
            yield from _flattened(v, f"{path}[{i}]")
    elif isinstance(value, bool):
        yield path, "Boolean", str(value).lower()
    elif value is None:
        yield path, "Null", None
    elif isinstance(value, int | float):
        yield path, "Number", json.dumps(value)
    else:
        yield path, "String", str(value)


def _xml(node: ElementTree.Element, path: str) -> Iterator[tuple[str, str, str | None]]:
    name = node.tag.rsplit("}", 1)[-1]
    path = f"{path}.{name}" if path else name
    text = (node.text or "").strip()
    yield path, "Object" if len(node) else "String", text or None
    for k, v in node.attrib.items():
        yield f"{path}.@{k}", "String", v
    for i, child in enumerate(node):
        yield from _xml(child, f"{path}[{i}]")


def _without_comments(text: str) -> str:
    """JSON without comments and commas before a closing bracket; strings are left alone."""
    out, i, quoted = [], 0, False
    while i < len(text):
        c = text[i]
        if quoted:
            out.append(text[i : i + 2] if c == "\\" else c)
            i += 1 + (c == "\\")
            quoted = c != '"'
            continue
        if text[i : i + 2] == "//":
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
            continue
        if text[i : i + 2] == "/*":
            end = text.find("*/", i)
            i = len(text) if end < 0 else end + 2
            continue
        if c in "]}":
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
        quoted = c == '"'
        out.append(c)
        i += 1
    return "".join(out)


def _documents(text: str) -> list[Any]:
    """The documents of a YAML text by libyaml, where it is there; what that can't read is left to the slower reader and its errors."""
    import yaml

    try:
        return list(yaml.load_all(text, yaml.CSafeLoader))
    except Exception:
        return list(yaml.safe_load_all(text))


def _parsed(path: str, text: str) -> list[tuple[str, str, str | None]]:
    name = path.rsplit("/", 1)[-1].lower()
    try:
        if name.endswith(".toml"):
            return list(_flattened(tomllib.loads(text), ""))
        if name.endswith((".yml", ".yaml")):
            return [x for d in _documents(text) for x in _flattened(d, "")]
        if name.endswith((".xml", ".csproj")):
            return list(_xml(ElementTree.fromstring(text), ""))
        return list(_flattened(json.loads(text if not name.startswith("tsconfig") else _without_comments(text)), ""))
    except Exception as error:  # a file that is broken is a fact about it, not an end of the scan
        return [("", "Error", type(error).__name__)]


#: Paths of the files that manifest_packages() reads.
MANIFESTS = r"(Cargo\.toml|(package|composer)\.json|pyproject\.toml|\.csproj|pom\.xml)$"
VALUES = "path string, config_path string, kind string, value string"


def structured(files: DataFrame) -> DataFrame:
    """path, config_path (a.b[0]), kind (Object, Array, String, Number, Boolean, Null, Error), value of JSON, YAML, TOML and XML files.

    By the ending of the name; tsconfig files may have comments. A file that can't be read gives one Error row.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *x) for p, t in zip(*(c.to_pylist() for c in batch.columns)) for x in _parsed(p, t)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "config_path", "kind", "value"])

    ship_package(files.sparkSession)
    return files.where("content IS NOT NULL").select("path", "content").mapInArrow(scan, VALUES)


def _at(values: DataFrame, pattern: str, *names: str) -> DataFrame:
    """Rows of values whose config_path fits, with the pattern's groups as columns."""
    found = values.where(F.col("config_path").rlike(pattern))
    return found.select("path", "config_path", "kind", "value", *[F.regexp_extract("config_path", pattern, k + 1).alias(n) for k, n in enumerate(names)])


def manifest_packages(values: DataFrame) -> DataFrame:
    """path, scope, package, version of manifests, from one pass over their structured values: Cargo, pyproject, npm, Composer, Maven, csproj."""
    at, path, value = F.col("config_path"), F.col("path"), F.col("value")
    none = F.lit(None).cast("string")
    taken = lambda here, pattern, scope, package, version, dependency=none, field=none: F.when(
        here & at.rlike(pattern), F.struct(dependency.alias("dependency"), field.alias("field"), scope.alias("scope"), package.alias("package"), version.alias("version"))
    )
    group = lambda pattern, k: F.regexp_extract(at, pattern, k)
    named = lambda here, pattern: taken(here, pattern, group(pattern, 1), group(pattern, 2), value)
    poetry, pep = r"^tool\.poetry\.(dependencies|dev-dependencies)\.([^.\[]+)(?:\.version)?$", r"^project\.(dependencies)\[\d+\]$"
    wanted = r"^\s*([A-Za-z0-9][A-Za-z0-9._\-]*)\s*(?:\[[^\]]*\])?\s*([^;]*)"
    of_pep = F.regexp_replace(F.lower(F.regexp_extract(value, wanted, 1)), "[_.]+", "-")
    reference, pom = r"PackageReference\.@(Include)$", r"^(.*dependencies\[\d+\]\.dependency)\[\d+\]\.(groupId|artifactId|version)$"
    is_pom, plain = path.endswith("pom.xml"), F.col("kind").isin("String", "Object")
    found = F.array(
        named(plain & path.endswith("Cargo.toml"), r"^(dependencies|dev-dependencies|build-dependencies|workspace\.dependencies)\.([^.\[]+)(?:\.version)?$"),
        named(plain & path.rlike(r"(package|composer)\.json$"), r"^(dependencies|devDependencies|peerDependencies|optionalDependencies|require|require-dev)\.([^\[]+)$"),
        named(plain & path.endswith("pyproject.toml"), poetry),
        taken(plain & path.endswith("pyproject.toml"), pep, group(pep, 1), of_pep, F.trim(F.regexp_extract(value, wanted, 2))),
        taken(plain & path.endswith(".csproj"), reference, group(reference, 1), value, none),
        taken(is_pom, pom, none, none, value, group(pom, 1), group(pom, 2)),
    )
    rows = values.where(path.rlike(MANIFESTS)).select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("path", "f.*")
    # the parts of a Maven dependency are put together first
    field = lambda name: F.max(F.when(F.col("field") == name, F.col("version"))).alias(name)
    rows = rows.groupBy("path", "dependency", "scope", "package").agg(F.max(F.when(F.col("field").isNull(), F.col("version"))).alias("plain"), field("groupId"), field("artifactId"), field("version"))
    joined = F.col("dependency").isNotNull()
    rows = rows.select(
        "path", F.when(joined, "dependency").otherwise(F.col("scope")).alias("scope"), F.when(joined, F.concat_ws(":", "groupId", "artifactId")).otherwise(F.col("package")).alias("package"),
        F.when(joined, F.col("version")).otherwise(F.col("plain")).alias("version"),
    )
    # a dependency may be a string or an object with a version; PEP 621 entries win over the same of another tool
    return rows.groupBy("path", "scope", "package").agg(F.max("version").alias("version"))


def compose_services(values: DataFrame) -> DataFrame:
    """path, service, image, builds, ports, depends_on (sorted) of compose files."""
    rows = _at(values, r"^services\.([^.\[]+)(.*)$", "service", "rest")
    rest = F.col("rest")
    needs = F.coalesce(F.when(rest.rlike(r"^\.depends_on\[\d+\]$"), F.col("value")), F.nullif(F.regexp_extract("rest", r"^\.depends_on\.([^.\[]+)$", 1), F.lit("")))
    return rows.groupBy("path", "service").agg(
        F.max(F.when(rest == ".image", F.col("value"))).alias("image"),
        F.max(rest.startswith(".build")).alias("builds"),
        F.array_sort(F.collect_set(F.when(rest.rlike(r"^\.ports\[\d+\]$"), F.col("value")))).alias("ports"),
        F.array_sort(F.collect_set(needs)).alias("depends_on"),
    )


def workflow_steps(values: DataFrame) -> DataFrame:
    """path, job, step, uses, run, image (the tag of a docker build), pushes of workflow files."""
    rows = _at(values, r"^jobs\.([^.\[]+)\.steps\[(\d+)\]\.(uses|run)$", "job", "step", "field")
    steps = rows.groupBy("path", "job", F.col("step").cast("int").alias("step")).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("uses", "run")])
    image = F.nullif(F.regexp_extract(F.coalesce("run", F.lit("")), r"docker build\s.*?(?:-t|--tag)[ =](\S+)", 1), F.lit(""))
    return steps.select("path", "job", "step", "uses", "run", image.alias("image"), F.coalesce("run", F.lit("")).contains("docker push").alias("pushes"))


def path_aliases(values: DataFrame) -> DataFrame:
    """path, base_url, pattern, target of tsconfig files (one row for each target, in order: at)."""
    base = values.where("config_path = 'compilerOptions.baseUrl'").select("path", F.col("value").alias("base_url"))
    rows = _at(values, r"^compilerOptions\.paths\.(.+)\[(\d+)\]$", "pattern", "at")
    return rows.join(base, "path", "left").select("path", F.coalesce("base_url", F.lit(".")).alias("base_url"), "pattern", F.col("at").cast("int").alias("at"), F.col("value").alias("target"))


def generic_facts(files: DataFrame) -> DataFrame:
    """path, line, kind (Url, Path, EnvVar, Image, Route), value: what words of any text look like; each once a line."""
    words = lines_of(files).select("path", "line", F.explode(F.array_distinct(F.split("text", r"[\s\"'`(),;<>\[\]{}]+"))).alias("word"))
    word = F.regexp_replace("word", r"[.:]+$", "")
    rows = words.select("path", "line", word.alias("value")).where("value <> ''").distinct()
    value = F.col("value")
    kind = (
        F.when(value.rlike(r"^https?://[^/]"), "Url")
        .when(value.rlike(r"^(?:[a-z0-9.\-]+(?::\d+)?/)?[a-z0-9._\-]+(?:/[a-z0-9._\-]+)*:[A-Za-z0-9][A-Za-z0-9._\-]*$") & ~value.rlike(r"^\d+:|://"), "Image")
        .when(value.rlike(r"^/(?:[A-Za-z0-9_\-{}:]+/?)+$"), "Route")
        .when(value.rlike(f"^(?:\\./|\\.\\./)*{PATH}$"), "Path")
        .when(value.rlike(r"^\$?\{?[A-Z][A-Z0-9]*_[A-Z0-9_]+\}?$"), "EnvVar")
    )
    return rows.select("path", "line", kind.alias("kind"), "value").where("kind IS NOT NULL")
