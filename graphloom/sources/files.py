"""A repository of files: from a folder, or laid out over the part table for the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.classify import is_test_file
from graphloom.functions.paths import glob_pattern
from graphloom.operators.ignore import ignore_rules, ignored

#: Files over the part table, in SQL that Spark and DuckDB both run: k, path, content, size_bytes.
FILES = """
SELECT k, path, size_bytes, CASE k % 26
  WHEN 0 THEN '# Guide ' || noun || chr(10) || 'See [the lib](../../src/' || noun || '/lib' || (k + 1) || '.rs) and ![logo](logo' || k || '.png).' || chr(10) || '```sh' || chr(10) || 'make ' || noun || chr(10) || 'cargo build' || chr(10) || '```' || chr(10) || '## Setup' || chr(10) || 'Set `' || upper(noun) || '_TOKEN` and read [docs](https://example.org/' || adj || ').' || chr(10) || 'TODO: planned work on ' || adj || chr(10) || 'The path src/' || noun || '/lib' || (k + 27) || '.rs holds it; GET /api/' || noun || ' returns it.'
  WHEN 1 THEN '// NOTE(' || adj || '): keep ' || noun || ' small' || chr(10) || 'pub fn ' || noun || '() {}' || chr(10) || '// TODO: split ' || adj
  WHEN 2 THEN 'import os' || chr(10) || 'def test_' || adj || '():' || chr(10) || '    assert True'
  WHEN 4 THEN 'FROM rust:1.' || (k % 90) || ' AS build' || chr(10) || 'ARG MODE=' || adj || chr(10) || 'WORKDIR /app' || chr(10) || 'COPY . .' || chr(10) || 'RUN cargo build' || chr(10) || 'FROM debian:12' || chr(10) || 'ENV LOG_LEVEL=info' || chr(10) || 'COPY --from=build /app/' || noun || ' /bin/' || noun || chr(10) || 'EXPOSE ' || (8000 + k % 1000) || chr(10) || 'CMD /bin/' || noun
  WHEN 5 THEN 'on: push' || chr(10) || 'jobs:' || chr(10) || '  build:' || chr(10) || '    steps:' || chr(10) || '      - run: docker build -t ' || noun || ' .'
  WHEN 6 THEN '# settings' || chr(10) || 'export ' || upper(noun) || '_URL=http://${' || upper(adj) || '_HOST}:80' || chr(10) || upper(noun) || '_PASSWORD=secret' || k || chr(10) || 'MODE="' || adj || '"'
  WHEN 9 THEN '{"name": "@acme/' || noun || k || '", "version": "1.' || (k % 7) || '.0", "dependencies": {"react": "^18.0.0", "' || adj || '-kit": "~2.' || (k % 5) || '"}, "tags": ["' || adj || '", "' || noun || '"]}'
  WHEN 11 THEN '-----BEGIN PRIVATE KEY-----' || chr(10) || adj || k || chr(10) || '-----END PRIVATE KEY-----' || chr(10) || 'done: yes'
  WHEN 13 THEN '# pinned' || chr(10) || 'requests==2.' || (k % 31) || '.0' || chr(10) || 'Flask>=2.0  # web' || chr(10) || '-r base.txt' || chr(10) || noun || '_lib[extra]~=1.' || (k % 9)
  WHEN 15 THEN 'CREATE TABLE ' || noun || ' (id INT);'
  WHEN 16 THEN noun || ':' || chr(10) || chr(9) || 'cargo build --release'
  WHEN 17 THEN '#!/bin/bash' || chr(10) || 'echo ' || adj
  WHEN 18 THEN 'module example.org/' || noun || k || chr(10) || 'go 1.21' || chr(10) || 'require (' || chr(10) || '  github.com/acme/' || adj || ' v1.' || (k % 5) || '.0' || chr(10) || '  golang.org/x/net v0.1.0 // indirect' || chr(10) || ')' || chr(10) || 'require example.org/one v0.0.1'
  WHEN 19 THEN 'service ' || noun || 'Api {' || chr(10) || '  rpc Get' || adj || ' (Req) returns (Res);' || chr(10) || '  rpc List (Req) returns (Res) {' || chr(10) || '  }' || chr(10) || '}' || chr(10) || 'message Req {' || chr(10) || '  string rpc = 1;' || chr(10) || '}'
  WHEN 24 THEN '# Code generated by tool. DO NOT EDIT' || chr(10) || 'x = 1'
  ELSE '' END AS content
FROM (SELECT *, CASE k % 26
  WHEN 0 THEN 'docs/' || adj || '/guide' || k || '.md'
  WHEN 1 THEN 'src/' || noun || '/lib' || k || '.rs'
  WHEN 2 THEN 'tests/' || noun || '/test_' || adj || k || '.py'
  WHEN 3 THEN 'app/components/' || noun || k || '.tsx'
  WHEN 4 THEN 'deploy/' || adj || k || '/Dockerfile'
  WHEN 5 THEN '.github/workflows/ci' || k || '.yml'
  WHEN 6 THEN 'config/' || noun || k || '/.env.production'
  WHEN 7 THEN 'vendor/' || noun || '/lib' || k || '.js'
  WHEN 8 THEN 'crates/' || noun || k || '/Cargo.toml'
  WHEN 9 THEN 'services/' || noun || k || '/package.json'
  WHEN 10 THEN 'api/routes/' || noun || k || '.go'
  WHEN 11 THEN 'secrets/' || adj || k || '.pem'
  WHEN 12 THEN 'stacks/' || adj || k || '/docker-compose.yml'
  WHEN 13 THEN 'py/' || noun || k || '/requirements.txt'
  WHEN 14 THEN 'py/' || noun || k || '/pyproject.toml'
  WHEN 15 THEN 'db/migrations/' || k || '_init.sql'
  WHEN 16 THEN 'tools/' || adj || k || '/Makefile'
  WHEN 17 THEN 'scripts/run_' || noun || k
  WHEN 18 THEN 'go/' || noun || k || '/go.mod'
  WHEN 19 THEN 'proto/' || noun || k || '.proto'
  WHEN 20 THEN 'assets/' || adj || k || '.png'
  WHEN 21 THEN 'web/' || adj || k || '/tsconfig.json'
  WHEN 22 THEN 'java/' || noun || k || '/pom.xml'
  WHEN 23 THEN 'domain/models/' || noun || k || '.java'
  WHEN 24 THEN 'examples/' || adj || '/demo' || k || '.py'
  ELSE 'generated/' || noun || k || '.ts' END AS path
  FROM (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, (p_partkey * 7919) % 1500000 AS size_bytes FROM {part}) AS p) AS q
"""


#: Files of eleven formats over the part table whose contents vary with its rows, in SQL that both run: k, path, content, size_bytes.
STACKS = """
SELECT k, path, length(content) AS size_bytes, content FROM (SELECT k, CASE k % 11
  WHEN 0 THEN 'docs/' || adj || '/note' || k || '.md'
  WHEN 1 THEN 'docker/' || noun || k || '/Dockerfile'
  WHEN 2 THEN 'stacks/' || adj || k || '/compose.yml'
  WHEN 3 THEN '.github/workflows/w' || k || '.yml'
  WHEN 4 THEN 'crates/' || noun || k || '/Cargo.toml'
  WHEN 5 THEN 'py/' || noun || k || '/pyproject.toml'
  WHEN 6 THEN 'web/' || noun || k || '/package.json'
  WHEN 7 THEN CASE WHEN k % 2 = 0 THEN 'config/' || noun || k || '/.env.' || adj ELSE 'config/' || noun || k || '/app.properties' END
  WHEN 8 THEN 'proto/' || noun || k || '.proto'
  WHEN 9 THEN 'py/r' || k || '/requirements.txt'
  ELSE 'go/' || noun || k || '/go.mod' END AS path, CASE k % 11
  WHEN 0 THEN '# About ' || noun || chr(10) || CASE WHEN k % 2 = 0 THEN 'See [the image](../../docker/' || noun || (k + 1) || '/Dockerfile) and [gone](missing' || k || '.md#top) and [web](https://example.org/' || adj || '/x.html).' ELSE 'It is in proto/' || noun || (k + 8) || '.proto and in none/' || noun || '.rs too.' END || chr(10)
    || CASE k % 4 WHEN 0 THEN '```sh' WHEN 1 THEN '~~~bash' WHEN 2 THEN '```python' ELSE '````console' END || chr(10) || '# a comment' || chr(10) || '$ make ' || noun || chr(10) || CASE WHEN k % 3 = 0 THEN 'run --all ' || adj || chr(10) || '' || chr(10) ELSE '' END
    || CASE k % 4 WHEN 0 THEN '```' WHEN 1 THEN '~~~' WHEN 2 THEN '```' ELSE '````' END || chr(10) || '## Use of ' || adj || ' ##' || chr(10) || '#none'
  WHEN 1 THEN CASE k % 3 WHEN 0 THEN 'FROM --platform=linux rust:1.' || (k % 90) || ' AS build' WHEN 1 THEN 'from debian:' || (k % 13) ELSE '# first' || chr(10) || 'FROM alpine' END || chr(10) || 'ARG MODE=' || adj || chr(10)
    || CASE WHEN k % 2 = 0 THEN 'RUN make \\' || chr(10) || '# between' || chr(10) || '  ' || noun ELSE 'RUN make ' || noun END || chr(10) || 'ENV ' || upper(adj) || '_HOME=/x B_' || (k % 5) || '=2' || chr(10) || 'EXPOSE 80' || chr(10) || 'FROM nginx:' || (k % 4) || chr(10) || 'CMD ["run", "' || noun || '"]'
  WHEN 2 THEN CASE WHEN k % 47 = 2 THEN 'services: [' ELSE 'services:' || chr(10) || '  web:' || chr(10) || '    image: ' || noun || ':' || (k % 5) || chr(10) || '    environment:' || chr(10)
    || CASE WHEN k % 2 = 0 THEN '      - ' || upper(noun) || '_URL=http' || chr(10) || '      - MODE' ELSE '      ' || upper(noun) || '_URL: http' || chr(10) || '      LEVEL: "' || (k % 3) || '"' END || chr(10)
    || '    depends_on:' || chr(10) || CASE WHEN k % 3 = 0 THEN '      - db' ELSE '      - cache' END || chr(10) || CASE WHEN k % 4 <> 0 THEN '  db:' || chr(10) || '    image: postgres:' || (10 + k % 7) || chr(10) ELSE '' END || 'volumes:' || chr(10) || '  ' || adj || ': {}' END
  WHEN 3 THEN 'on: push' || chr(10) || 'jobs:' || chr(10) || '  build:' || chr(10) || '    steps:' || chr(10) || '      - uses: actions/checkout@v4' || chr(10) || '      - run: docker build -t ' || noun || ':' || (k % 6) || ' .' || chr(10) || '        env:' || chr(10) || '          CI_' || upper(adj) || ': "1"' || chr(10)
    || '      - run: ' || CASE WHEN k % 2 = 0 THEN 'docker push ' || noun || ':' || (k % 6) ELSE 'make ' || adj END || CASE WHEN k % 5 = 0 THEN chr(10) || '  ' || adj || ':' || chr(10) || '    steps:' || chr(10) || '      - run: echo ' || noun ELSE '' END
  WHEN 4 THEN '[package]' || chr(10) || 'name = "' || noun || k || '"' || chr(10) || '[dependencies]' || chr(10) || 'serde = "1.' || (k % 9) || '"' || chr(10) || adj || ' = { version = "0.' || (k % 4) || '", optional = true }' || CASE WHEN k % 2 = 0 THEN chr(10) || '[dev-dependencies]' || chr(10) || 'proptest = "1"' ELSE '' END
  WHEN 5 THEN '[project]' || chr(10) || 'name = "' || noun || '-' || k || '"' || chr(10) || 'dependencies = [' || chr(10) || '  "requests>=2.' || (k % 5) || '",' || chr(10) || '  "' || adj || '_lib[extra]==1"' || CASE WHEN k % 2 = 0 THEN ',' || chr(10) || '  "Flask"' ELSE '' END || chr(10) || ']'
  WHEN 6 THEN '{' || chr(10) || '  "name": "@acme/' || noun || k || '",' || chr(10) || '  "dependencies": {' || chr(10) || '    "react": "^18.0.' || (k % 5) || '",' || chr(10) || '    "' || adj || '-kit": "~2"' || chr(10) || '  }' || CASE WHEN k % 2 = 0 THEN ',' || chr(10) || '  "devDependencies": {' || chr(10) || '    "jest": "29"' || chr(10) || '  }' ELSE '' END || chr(10) || '}'
  WHEN 7 THEN '# of ' || adj || chr(10) || CASE WHEN k % 2 = 0 THEN 'export ' || upper(noun) || '_URL="http://${' || upper(adj) || '_HOST}:$PORT"' || chr(10) || '! no' || chr(10) || 'MODE=' || adj ELSE 'server.' || noun || '.port=80' || chr(10) || 'name: ${' || upper(noun) || '}' END
  WHEN 8 THEN 'service ' || noun || 'Api {' || chr(10) || '  rpc Get (Req) returns (Res);' || chr(10) || CASE WHEN k % 2 = 0 THEN '  rpc Put' || adj || ' (Req) returns (Res) {' || chr(10) || '  }' || chr(10) ELSE '' END || '}' || chr(10) || 'message Req {' || chr(10) || '  string rpc = 1; // rpc No (x)' || chr(10) || '}'
  WHEN 9 THEN '# pinned' || chr(10) || 'requests==2.' || (k % 31) || chr(10) || '-r base.txt' || chr(10) || CASE WHEN k % 2 = 0 THEN 'Flask_Login>=2  # web' || chr(10) ELSE '' END || adj || '.' || noun || '[x]~=1'
  ELSE 'module example.org/' || noun || k || chr(10) || 'require (' || chr(10) || '  github.com/acme/' || adj || ' v1.' || (k % 5) || '.0' || chr(10) || '  golang.org/x/net v0.1.0 // indirect' || chr(10) || ')' || CASE WHEN k % 2 = 0 THEN chr(10) || 'require example.org/' || noun || ' v0.0.1' || chr(10) || 'replace example.org/a => ../a' ELSE '' END
  END AS content FROM (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM {part}) AS p) AS q
"""


#: Parts whose files one task makes.
PARTS = 20_000


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers and names of parts, dealt over all cores, some to a task: their files are far larger than the rows that Spark cuts into tasks."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    return part.repartition(max(2 * spark.sparkContext.defaultParallelism, part.count() // PARTS), "p_partkey")


def stack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, path, size_bytes, content of the files of STACKS."""
    text = STACKS.replace("{", "{{").replace("}", "}}").replace("{{part}}", "{part}")
    return spark.sql(text.replace("\\", "\\\\"), part=_parts(spark, sf_dir))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, path, size_bytes, content of the files over the part table."""
    text = FILES.replace("{", "{{").replace("}", "}}").replace("{{part}}", "{part}")
    return spark.sql(text, part=_parts(spark, sf_dir))


def walk(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), tests: bool = False, hidden: bool = False, ignores: DataFrame | None = None) -> DataFrame:
    """The files under a folder or a store's prefix: path (from the root), content (bytes), size_bytes; no hidden folders, no test paths.

    excludes: globs over the path. ignores: ignore files as a table (path, content), whose rules hold from their folders down.
    Spark lists the files, so a repository of any size is read by all executors. Spark's readers pass over names that begin with
    a dot or an underscore, so dotfiles have to come from a table.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.regexp_extract("path", f"(?:^|[^/]){_quoted(base)}/(.*)$", 1), "%20", " ")
    out = found.select(path.alias("path"), "content", F.col("length").alias("size_bytes"))
    return walked(out, excludes, tests, hidden, ignores)


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def walked(files: DataFrame, excludes: tuple[str, ...] = (), tests: bool = False, hidden: bool = False, ignores: DataFrame | None = None) -> DataFrame:
    """The files that a walk keeps: none under .git, a hidden folder, an excluded or ignored path, and no test files."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    keep = ~F.array_contains(folders, ".git")
    if not hidden:
        keep &= ~F.exists(folders, lambda p: p.startswith("."))
    if not tests:
        keep &= ~is_test_file(F.col("path"))
    for pattern in excludes:
        keep &= ~F.col("path").rlike(glob_pattern(pattern))
    kept = files.where(keep)
    if ignores is None:
        return kept
    out = ignored(kept, ignore_rules(ignores)).where("ignored").select("path")
    return kept.join(out, "path", "left_anti").select(*files.columns)


def read_facts(content: Column) -> tuple[Column, Column, Column]:
    """Of a file's bytes: their digest, Text or Binary (a zero byte or no UTF-8), and the lines of a text."""
    binary = (F.instr(F.hex(content), "00") > 0) & F.hex(content).rlike("^(..)*?00")
    text = F.try_validate_utf8(content.cast("string"))
    status = F.when(binary | text.isNull(), "Binary").otherwise("Text")
    lines = F.when(F.length(content) == 0, 0).otherwise(F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0))
    return F.sha2(content, 256), status, F.when(status == "Text", lines)
