"""Facts and edges of odd files."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import classify
from graphloom.operators import extract, facts

FILES = [
    ("a/Dockerfile", "Dockerfile", "# c\nFROM --platform=x base:1 AS b\r\nRUN a \\\n# note \\\n  && b\nENV A=1 B=2\nEXPOSE 80 \\\n"),
    ("a/x.md", "Markdown", "# T #\n~~~~sh\n$ go\n~~~\n# no\n~~~~\n[l](/b/y.md#t) [w](http://x/y.md) `b/y.md` c/none.md\n```\nmake\n"),
    ("b/y.md", "Markdown", None),
    ("b/empty.md", "Markdown", ""),
    ("c/compose.yml", "Compose", "services:\n  a:\n    image: i\n    depends_on:\n      b: {condition: x}\n  b: null\n"),
    ("c/broken.yml", "Compose", "a: ["),
    (".github/workflows/x.yml", "Actions", "jobs:\n  j:\n    steps:\n      - run: |\n          docker build .\n      - run: docker build --tag=t:1 .\n"),
    ("d/.env", "Environment", "A=$B-${C}\n#D=1\nnot a setting\na.b=1\n"),
    ("e/x.proto", "Protocol", "message M {\n rpc No (a)\n}\nservice S {\n rpc X (a) returns (b);\n}\nrpc Out (x)"),
    ("f/x.bin", None, "zzz"),
    ("f/x.txt", "GenericText", "zzz"),
]


def test_facts(spark):
    rows = facts.facts(spark.createDataFrame(FILES, "path string, analyzer string, content string"))
    got = {(r.path, r.fact, r.line, r.name) for r in rows.select("path", "fact", "line", F.variant_get("detail", "$.name", "string").alias("name")).where("fact <> 'value'").collect()}
    assert got == {
        ("a/Dockerfile", "image", 2, "base:1"), ("a/Dockerfile", "command", 3, "a    && b"), ("a/Dockerfile", "env", 6, "A"), ("a/Dockerfile", "env", 6, "B"), ("a/Dockerfile", "expose", 7, "80"),
        ("a/x.md", "heading", 1, "T"), ("a/x.md", "command", 3, "go"), ("a/x.md", "command", 4, "~~~"), ("a/x.md", "link", 7, "/b/y.md"), ("a/x.md", "path", 7, "b/y.md"), ("a/x.md", "path", 7, "c/none.md"),
        ("d/.env", "define", 1, "A"), ("d/.env", "env", 1, "B"), ("d/.env", "env", 1, "C"), ("d/.env", "key", 4, "a.b"), ("e/x.proto", "route", 5, "S.X"),
    }


def test_typed_edges(spark):
    edges = facts.typed_edges(spark.createDataFrame(FILES, "path string, analyzer string, content string"))
    got = {tuple(r) for r in edges.where("kind IN ('References', 'UsesImage', 'BuildsImage', 'Contains')").select("source", "target", "kind", "label").collect()}
    at = "config:c/compose.yml#services."
    assert got == {
        ("artifact:a/Dockerfile", "image:base:1", "UsesImage", "Container"), ("artifact:a/x.md", "doc:a/x.md#1", "Contains", "Documentation"), ("artifact:a/x.md", "artifact:b/y.md", "References", "Artifact"),
        ("artifact:c/compose.yml", at + "a", "Contains", "Config"), ("artifact:c/compose.yml", at + "b", "Contains", "Config"), (at + "a", "image:i", "UsesImage", "Container"), (at + "a", at + "b", "References", "Config"),
        ("artifact:.github/workflows/x.yml", "config:.github/workflows/x.yml#jobs.j", "Contains", "Config"), ("config:.github/workflows/x.yml#jobs.j", "image:t:1", "BuildsImage", "Container"),
        ("config:.github/workflows/x.yml#jobs.j", "unresolved:dynamic-image", "BuildsImage", "Unresolved"), ("artifact:e/x.proto", "config:e/x.proto#route.0", "Contains", "Config"),
    }
    assert facts.typed_edges(spark.createDataFrame([], "path string, analyzer string, content string")).count() == 0


def test_edges_that_are_refused(spark):
    rows = [("ReadsEnv", "EnvVar", 1), ("ReadsEnv", "Symbol", 2), ("ReadsEnv", "Unresolved", 3), ("References", "Symbol", 4)]
    kept = facts.checked_targets(spark.createDataFrame(rows, "kind string, label string, n int"))
    assert {r.n for r in kept.collect()} == {1, 3, 4}


def test_classification_of_odd_files(spark):
    rows = [(None, "FROM x", 1), ("", None, None), ("a/migrations/x.unknown", "", 0), ("a/Cargo.toml", "", 2_000_000), ("tests/fixtures/a.txt", "", 1), ("x.svg", "", 1), ("noext", "#!/usr/bin/env python3\nx", 1)]
    found = classify.classified(spark.createDataFrame(rows, "path string, content string, size_bytes long")).collect()
    got = {r.path: (r.category, r.format, r.tier, r.policy) for r in found}
    assert got == {
        None: ("ContainerDefinition", "dockerfile", "StructuredFormat", "Allowed"), "": ("UnknownText", None, "GenericText", "Allowed"), "a/migrations/x.unknown": ("DatabaseMigration", "unknown", "GenericText", "Allowed"),
        "a/Cargo.toml": ("PackageManifest", "toml", "Opaque", "ExcerptOnly"), "tests/fixtures/a.txt": ("TestData", "txt", "GenericText", "ExcerptOnly"), "x.svg": ("StaticAsset", "svg", "GenericText", "ExcerptOnly"),
        "noext": ("SourceCode", "python", "DeepLanguage", "Allowed"),
    }
    one = spark.createDataFrame([("zig", "zig", "SourceCode", "GenericText", "GenericText")], "extension string, language string, category string, tier string, analyzer string")
    assert classify.classified(spark.createDataFrame([("a.zig", "", 1)], "path string, content string, size_bytes long"), one).first().format == "zig"


def test_manifests_are_read_once(spark):
    rows = [("a/Cargo.toml", '[dependencies]\nx = "1"\n[dependencies.y]\nversion = "2"'), ("a/pom.xml", "<p><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>3</version></dependency></dependencies></p>"), ("a/package.json", "[")]
    found = extract.manifest_packages(extract.structured(spark.createDataFrame(rows, "path string, content string")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {tuple(r) for r in found.collect()} == {("a/Cargo.toml", "dependencies", "x", "1"), ("a/Cargo.toml", "dependencies", "y", "2"), ("a/pom.xml", "dependency", "g:a", "3")}


def test_yaml_is_read_by_libyaml(monkeypatch):
    yaml = pytest.importorskip("yaml")
    slow = yaml.safe_load_all
    asked = []
    monkeypatch.setattr(yaml, "safe_load_all", lambda text: (asked.append(text), slow(text))[1])
    assert extract._parsed("x.yml", "a: [1, yes]") == [("", "Object", None), ("a", "Array", None), ("a[0]", "Number", "1"), ("a[1]", "Boolean", "true")]
    assert not asked or not hasattr(yaml, "CSafeLoader")
    assert extract._parsed("x.yml", "a: [") == [("", "Error", "ParserError")]


def test_described_facts_are_written(spark, monkeypatch):
    names, write = [], facts.written
    monkeypatch.setattr(facts, "written", lambda df, name: (names.append(name), write(df, name))[1])
    edges = facts.typed_edges(spark.createDataFrame(FILES, "path string, analyzer string, content string"))
    assert names == ["file-facts", "described-facts", "edges-made"]
    assert "variant_get" not in edges._jdf.queryExecution().optimizedPlan().toString()
