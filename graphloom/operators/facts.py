"""One pass over files: a scan over Arrow batches gives each file's facts of all kinds, and typed edges follow from the facts by tables.

A file's text is read once. Its analyzer (functions.classify.analyzer) says what is looked for; every fact is a row with its kind,
line and a variant. Which edge a fact makes, from what to what, is said by EDGES; what an edge may point to by TARGETS.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import resolved
from graphloom.operators.extract import LINK, PATH, SHELLS, _parsed, manifest_packages
from graphloom.storage import ship_package, written

FACTS = "path string, analyzer string, seq int, fact string, line int, detail string"
NAMES, TYPES = ("path", "analyzer", "seq", "fact", "line", "detail"), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
#: Facts that a task hands on at once.
BATCH = 10_000
#: Analyzers whose files are read as structured values.
STRUCTURED = ("Compose", "Actions", "Cargo", "PyProject", "PackageManifest", "Structured")
# What edges of a kind may point to. Kinds that are not listed may point to anything; Unresolved is always allowed.
TARGETS = (
    ("BelongsToPackage", "Package"), ("DependsOnPackage", "Package"), ("ReadsEnv", "EnvVar"), ("DefinesEnv", "EnvVar"),
    ("RunsCommand", "Command"), ("UsesImage", "Container"), ("BuildsImage", "Container"), ("PublishesImage", "Container"),
    ("BindsConfig", "Config"), ("ReferencesConfig", "Config"),
)
#: fact, edge kind, label of the target.
EDGES = (
    ("image", "UsesImage", "Container"), ("env", "ReadsEnv", "EnvVar"), ("define", "DefinesEnv", "EnvVar"), ("command", "RunsCommand", "Command"), ("heading", "Contains", "Documentation"),
    ("link", "References", "Artifact"), ("path", "References", "Artifact"), ("service", "Contains", "Config"), ("needs", "References", "Config"), ("job", "Contains", "Config"),
    ("builds", "BuildsImage", "Container"), ("pushes", "PublishesImage", "Container"), ("route", "Contains", "Config"), ("local", "BelongsToPackage", "Package"),
    ("package", "DependsOnPackage", "Package"), ("key", "BindsConfig", "Config"),
)
PREFIXES = {"Container": "image:", "EnvVar": "env:", "Command": "command:", "Documentation": "doc:", "Artifact": "artifact:", "Config": "config:", "Package": "package:"}

_VARIABLE = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)")
_KEY = re.compile(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.\-]*)\s*[=:]\s*(.*?)\s*$")
_INSTRUCTION = re.compile(r"\s*([A-Za-z]+)(?:\s+(.*))?$")


def _docker(text: str) -> Iterator[tuple[str, int, dict[str, Any]]]:
    stage, begun = 0, None
    held = ""
    for line, row in enumerate([*text.split("\n"), ""], 1):
        row = row.rstrip("\r")
        if row.lstrip().startswith("#"):
            continue  # a comment ends no line that is continued
        begun = begun if held else line
        if row.rstrip(" \t").endswith("\\"):
            held += row.rstrip(" \t")[:-1] + " "
            continue
        full, held = held + row, ""
        found = _INSTRUCTION.match(full)
        if not found:
            continue
        word, rest = found.group(1).upper(), (found.group(2) or "").strip()
        if word == "FROM":
            stage += 1
            parts = [x for x in rest.split() if not x.startswith("--")]
            if parts:
                yield "image", begun, {"name": parts[0], "stage": stage, "as": parts[2] if len(parts) > 2 and parts[1].upper() == "AS" else None}
        elif word in ("ENV", "ARG"):
            pairs = re.findall(r"([A-Za-z_]\w*)=", rest) or re.findall(r"^([A-Za-z_]\w*)", rest)
            for name in pairs:
                yield "env", begun, {"name": name, "from": word}
        elif word in ("RUN", "CMD", "ENTRYPOINT"):
            yield "command", begun, {"name": rest, "from": word, "stage": stage}
        elif word in ("EXPOSE", "VOLUME", "WORKDIR", "USER", "LABEL", "COPY", "ADD", "STOPSIGNAL", "SHELL", "HEALTHCHECK"):
            yield word.lower(), begun, {"name": rest, "stage": stage}


def _markdown(text: str) -> Iterator[tuple[str, int, dict[str, Any]]]:
    fence, language = "", ""
    for line, row in enumerate(text.split("\n"), 1):
        row = row.rstrip("\r")
        mark = re.match(r" {0,3}(`{3,}|~{3,})\s*([A-Za-z0-9_+\-]*)\s*", row)
        if mark and not fence:
            fence, language = mark.group(1), mark.group(2).lower()
        elif mark and mark.group(1).startswith(fence) and not row[mark.end(1) :].strip():
            fence = ""
        elif fence:
            command = re.sub(r"^\s*\$ ", "", row).strip()
            if language in SHELLS and command and not command.startswith("#"):
                yield "command", line, {"name": command}
        else:
            if head := re.match(r"(#{1,6})\s+(\S.*?)[\s#]*$", row):
                yield "heading", line, {"name": head.group(2), "level": len(head.group(1))}
            for found in re.finditer(LINK, row):
                if not re.match(r"([A-Za-z][A-Za-z0-9+.\-]*:|//|#)", found.group(3)):
                    yield "link", line, {"name": re.sub(r"[#?].*$", "", found.group(3))}
            plain = re.sub(r"[A-Za-z][A-Za-z0-9+.\-]*://\S*", " ", re.sub(LINK, " ", row))
            for found in sorted(set(re.findall(PATH, plain))):
                yield "path", line, {"name": found}


def _environment(text: str) -> Iterator[tuple[str, int, dict[str, Any]]]:
    for line, row in enumerate(text.split("\n"), 1):
        found = None if re.match(r"\s*[#!;]", row) else _KEY.match(row)
        if found:
            yield "key" if "." in found.group(1) else "define", line, {"name": found.group(1)}
            for name in sorted(set(_VARIABLE.findall(found.group(2)))):
                yield "env", line, {"name": name, "from": "value"}


def _protocol(text: str) -> Iterator[tuple[str, int, dict[str, Any]]]:
    depth, owner, number = 0, None, 0
    for line, row in enumerate(text.split("\n"), 1):
        row = re.sub(r"//.*$", "", row)
        top = re.match(r"\s*(service|message|enum)\s+([A-Za-z_]\w*)", row)
        if top and depth == 0:
            owner = top.group(2) if top.group(1) == "service" else None
        call = re.match(r"\s*rpc\s+([A-Za-z_]\w*)\s*\(", row)
        if call and owner and depth >= 1:
            yield "route", line, {"name": f"{owner}.{call.group(1)}", "number": number}
            number += 1
        depth += row.count("{") - row.count("}")


def _requirements(text: str) -> Iterator[tuple[str, int, dict[str, Any]]]:
    for line, row in enumerate(text.split("\n"), 1):
        if found := re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._\-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)", row):
            yield "package", line, {"name": re.sub(r"[_.]+", "-", found.group(1).lower()), "version": found.group(2).strip()}


def _go(text: str) -> Iterator[tuple[str, int, dict[str, Any]]]:
    block = ""
    for line, row in enumerate(text.split("\n"), 1):
        words = re.sub(r"//.*$", "", row).split()
        if words[:1] == ["module"] and len(words) > 1:
            yield "local", line, {"name": words[1]}
        elif len(words) > 1 and words[1].startswith("("):
            block = words[0]
        elif words[:1] == [")"]:
            block = ""
        elif block == "require" or words[:1] == ["require"]:
            words = words[words[:1] == ["require"] :]
            if len(words) > 1 and words[1].startswith("v"):
                yield "package", line, {"name": words[0], "version": words[1]}


_READERS = {"Dockerfile": _docker, "Markdown": _markdown, "Environment": _environment, "Protocol": _protocol, "Requirements": _requirements}


def _facts_of(path: str, analyzer: str, content: str) -> Iterator[tuple[int, str, int | None, str]]:
    """seq, fact, line, detail (JSON) of a file."""
    if content is None or analyzer is None:
        return
    if analyzer in STRUCTURED and not path.endswith(("go.mod", ".gradle", ".gradle.kts")):
        found = (("value", None, {"path": p, "kind": kind, "value": value}) for p, kind, value in _parsed(path, content))
    elif path.endswith("go.mod"):
        found = _go(content)
    else:
        found = _READERS[analyzer](content) if analyzer in _READERS else ()
    for seq, (fact, line, detail) in enumerate(found):
        yield seq, fact, line, json.dumps(detail)


def facts(files: DataFrame) -> DataFrame:
    """files: path, analyzer, content. path, analyzer, seq, fact, line, detail (variant), each file read once.

    A file without content or with an analyzer that has no reader gives no rows; one that can't be parsed gives a value of
    kind Error. Repeated files give their facts each.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((path, analyzer, *fact) for path, analyzer, content in zip(*(c.to_pylist() for c in batch.columns)) for fact in _facts_of(path, analyzer, content))
            while some := list(islice(rows, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), TYPES)], names=NAMES)

    ship_package(files.sparkSession)
    rows = files.select("path", "analyzer", "content").where("content IS NOT NULL AND analyzer IS NOT NULL").mapInArrow(scan, FACTS)
    return rows.withColumn("detail", F.parse_json("detail"))


def _detail(name: str) -> Column:
    return F.variant_get("detail", f"$.{name}", "string")


def _described(rows: DataFrame) -> DataFrame:
    """Facts as path, fact, owner (null: the file), name, key, line: those of structured values taken from their paths."""
    named = rows.where("fact <> 'value'").select("path", "analyzer", "fact", F.lit(None).cast("string").alias("owner"), _detail("name").alias("name"), F.coalesce(_detail("number"), F.col("line").cast("string")).alias("key"), "line")
    values = rows.where("fact = 'value'").select("path", "analyzer", _detail("path").alias("config_path"), _detail("kind").alias("kind"), _detail("value").alias("value"))
    at, value = F.col("config_path"), F.col("value")
    group = lambda pattern, k: F.nullif(F.regexp_extract(at, pattern, k), F.lit(""))
    service, job = group(r"^services\.([^.\[]+)", 1), group(r"^jobs\.([^.\[]+)", 1)
    image = lambda pattern: F.nullif(F.regexp_extract(value, pattern, 1), F.lit(""))
    fact = lambda when, name, of, owner=None, key=None: F.when(
        when, F.struct(F.lit(of).alias("fact"), (F.lit(None).cast("string") if owner is None else owner).alias("owner"), name.alias("name"), (F.lit(None).cast("string") if key is None else key).alias("key"))
    )
    of_service, of_job = F.concat(F.lit("services."), service), F.concat(F.lit("jobs."), job)
    step = group(r"^(jobs\.[^.\[]+\.steps\[\d+\])", 1)
    compose, actions = F.col("analyzer") == "Compose", F.col("analyzer") == "Actions"
    run = actions & at.rlike(r"^jobs\.[^.\[]+\.steps\[\d+\]\.run$")
    builds, pushes = run & value.contains("docker build"), run & value.contains("docker push")
    local = at.isin("package.name", "project.name") & F.col("analyzer").isin("Cargo", "PyProject") | (at == "name") & F.col("path").rlike(r"(package|composer)\.json$")
    local = local | (at == "tool.poetry.name") & (F.col("analyzer") == "PyProject")
    found = F.array(
        fact(compose & at.rlike(r"^services\.[^.\[]+$"), of_service, "service"),
        fact(compose & at.rlike(r"^services\.[^.\[]+\.image$"), value, "image", of_service),
        fact(compose & at.rlike(r"^services\.[^.\[]+\.environment\.[^.\[]+$"), group(r"environment\.([^.\[]+)$", 1), "env", of_service),
        fact(compose & at.rlike(r"^services\.[^.\[]+\.environment\[\d+\]$"), F.regexp_extract(value, "^[^=]*", 0), "env", of_service),
        fact(compose & at.rlike(r"^services\.[^.\[]+\.depends_on\[\d+\]$"), F.concat(F.lit("services."), value), "needs", of_service),
        fact(compose & at.rlike(r"^services\.[^.\[]+\.depends_on\.[^.\[]+$"), F.concat(F.lit("services."), group(r"depends_on\.([^.\[]+)$", 1)), "needs", of_service),
        fact(actions & at.rlike(r"^jobs\.[^.\[]+$"), of_job, "job"),
        fact(actions & at.rlike(r"^jobs\.[^.\[]+\.steps\[\d+\]\.env\.[^.\[]+$"), group(r"env\.([^.\[]+)$", 1), "env", of_job),
        fact(run, value, "command", of_job, step),
        fact(builds, image(r"docker build\s(?:.*?\s)?(?:-t|--tag)[ =](\S+)"), "builds", of_job),
        fact(pushes & ~builds, image(r"docker push\s+(\S+)"), "pushes", of_job),
        fact(local & (F.col("kind") == "String"), value, "local"),
    )
    from_values = values.select("path", "analyzer", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("path", "analyzer", "f.*", F.lit(None).cast("int").alias("line"))
    packages = manifest_packages(values).select("path", F.lit("Manifest").alias("analyzer"), F.lit("package").alias("fact"), F.lit(None).cast("string").alias("owner"), F.col("package").alias("name"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("line"))
    both = written(named.unionByName(from_values).unionByName(packages), "described-facts")
    # dependencies belong to the package that a manifest declares, else to the file
    own = both.where("fact = 'local'").groupBy("path").agg(F.min("name").alias("local"))
    return both.join(own, "path", "left")


def typed_edges(files: DataFrame) -> DataFrame:
    """files: path, analyzer, content. Edges id, source, target, kind, label (of the target), confidence; each once.

    Documents' references to files that are not there are left out, other ones point to an unresolved node. Edges whose kind may
    not point to the target's label are refused (none can come of EDGES; a table of one's own may have some).
    """
    spark = files.sparkSession
    found = written(facts(files), "file-facts")
    rows = _described(found)
    edges = F.broadcast(spark.createDataFrame(EDGES, "fact string, kind string, label string"))
    artifact, mine = F.concat(F.lit("artifact:"), "path"), F.concat(F.lit("config:"), "path", F.lit("#"))
    source = F.when(F.col("owner").isNotNull(), F.concat(mine, "owner")).when((F.col("fact") == "package") & F.col("local").isNotNull(), F.concat(F.lit("package:"), "local")).otherwise(artifact)
    name = F.col("name")
    target = (
        F.when(F.col("label") == "Command", F.concat(F.lit("command:"), "path", F.lit("#"), "key"))
        .when(F.col("label") == "Documentation", F.concat(F.lit("doc:"), "path", F.lit("#"), "key"))
        .when(F.col("fact") == "route", F.concat(mine, F.lit("route."), "key"))
        .when(F.col("fact") == "key", F.concat(F.lit("config-key:"), name))
        .when(F.col("label") == "Config", F.concat(mine, name))
        .when(F.col("label") == "Container", F.coalesce(F.concat(F.lit("image:"), name), F.lit("unresolved:dynamic-image")))
        .when(F.col("label") == "EnvVar", F.concat(F.lit("env:"), name))
        .when(F.col("label") == "Package", F.concat(F.lit("package:"), name))
        .otherwise(F.concat(F.lit("artifact:"), F.ltrim(name, F.lit("/"))))
    )
    made = rows.join(edges, "fact").select("fact", "path", source.alias("source"), target.alias("target"), "kind", "label", "name").where("target IS NOT NULL")
    made = written(made, "edges-made")
    # files and services that are pointed to have to be there; a path is taken from the file's folder, else from the root
    there = files.select(F.concat(F.lit("artifact:"), "path").alias("target")).unionByName(made.where("fact = 'service'").select("target")).distinct()
    beside = F.when(F.col("fact").isin("link", "path") & ~name.startswith("/"), F.concat(F.lit("artifact:"), resolved(F.col("path"), name)))
    pointing = made.where("fact IN ('link', 'path', 'needs')").withColumn("beside", beside)
    pointing = pointing.join(there.select(F.col("target").alias("beside"), F.lit(True).alias("is_beside")), "beside", "left").join(there.withColumn("is_there", F.lit(True)), "target", "left")
    absent = F.when(F.col("fact") == "needs", F.concat(F.lit("unresolved:"), F.regexp_replace("name", "^services\\.", "")))
    hit = F.when(F.col("is_beside"), F.col("beside")).when(F.col("is_there"), F.col("target")).otherwise(absent)
    pointing = pointing.select("source", hit.alias("target"), "kind", "label").where("target IS NOT NULL")
    made = made.where("fact NOT IN ('link', 'path', 'needs')").select("source", "target", "kind", "label").unionByName(pointing)
    label = F.when(F.col("target").startswith("unresolved:"), "Unresolved").otherwise(F.col("label"))
    made = made.select("source", "target", "kind", label.alias("label")).distinct()
    checked = checked_targets(made)
    confidence = F.when(F.col("label") == "Unresolved", "Low").otherwise("High")
    return checked.select(F.concat_ws("|", "kind", "source", "target").alias("id"), "source", "target", "kind", "label", confidence.alias("confidence"))


def checked_targets(edges: DataFrame) -> DataFrame:
    """The edges (kind, label, ...) whose kind may point to the label, by TARGETS."""
    spark = edges.sparkSession
    allowed = F.broadcast(spark.createDataFrame(TARGETS, "kind string, allowed string").groupBy("kind").agg(F.collect_set("allowed").alias("allowed")))
    return edges.join(allowed, "kind", "left").where("label = 'Unresolved' OR allowed IS NULL OR array_contains(allowed, label)").drop("allowed")


def summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("targets"))
