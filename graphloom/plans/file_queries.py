"""Queries over a repository of files laid out over the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import classify, paths
from graphloom.operators import extract, findings, planning, relational, resolve, syntax
from graphloom.plans.registry import query
from graphloom.sources.files import FILES, files, read_facts, walked

#: The files and their lines in SQL.
F_ = "files AS (" + FILES.replace("{part}", "part") + ")"
L_ = f"{F_}, flines AS (SELECT k, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)"
NAME = "regexp_extract(path, '[^/]*$')"
EXT = f"CASE WHEN regexp_matches({NAME}, '^.+\\.') THEN regexp_extract({NAME}, '^.+\\.([^.]*)$', 1) END"
TEST = f"(len(list_intersect(string_split(path, '/'), ['test', 'tests', '__tests__', 'spec', 'specs'])) > 0 OR regexp_matches({NAME}, '^(test_|spec_)') OR regexp_matches({NAME}, '(_test\\.rs|_tests\\.rs|\\.(test|spec)\\.(rs|ts|tsx|js|jsx)|\\.e2e-spec\\.ts|\\.e2e\\.ts)$'))"
SECRET = f"(lower({NAME}) IN ('.env', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519', '.npmrc', '.pypirc', 'credentials', 'credentials.json', 'secrets.yml', 'secrets.yaml') OR starts_with(lower({NAME}), '.env.') OR regexp_matches(lower({NAME}), '\\.(pem|key|p12|pfx)$') OR contains(lower(path), '/.aws/credentials') OR contains(lower(path), '/.config/gcloud/'))"
GENERATED = "regexp_matches(lower(content), 'do not edit|do not modify|@generated|code generated by|generated by the protocol buffer compiler|autogenerated|auto-generated|this file was automatically generated')"


@query(f"WITH {F_} SELECT path, {TEST} AS test, ({TEST} OR len(list_intersect(string_split(path, '/'), ['docs', 'examples', 'example', 'benches', 'benchmark', 'benchmarks', 'sample', 'samples', 'integration', 'e2e'])) > 0) AS auxiliary, {SECRET} AS secret FROM files")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return files(spark, sf_dir).select("path", classify.is_test_file(path).alias("test"), classify.is_auxiliary_file(path).alias("auxiliary"), classify.is_secret_path(path).alias("secret"))


@query(f"WITH {F_} SELECT path, size_bytes FROM files WHERE NOT {TEST} AND NOT regexp_matches(path, '(^|/)\\.[^/]*/') AND NOT regexp_matches(path, '^vendor/.*$') AND NOT regexp_matches(path, '^.*\\.(png|pem)$')")
def walked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk keeps with two excluded globs."""
    return walked(files(spark, sf_dir), ("vendor/**", "*.{png,pem}")).select("path", "size_bytes")


@query(f"WITH {F_} SELECT path, sha256(content) AS digest, 'Text' AS status, (CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END)::INTEGER AS n_lines FROM files")
def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest, status, lines = read_facts(F.col("content").cast("binary"))
    return files(spark, sf_dir).select("path", digest.alias("digest"), status.alias("status"), lines.alias("n_lines"))


_CLASS_ROWS = ", ".join(f"('{n}', '{c}', '{f}', '{t}', '{a}', '{'ExcerptOnly' if f == 'lockfile' else 'Allowed'}')" for n, c, f, t, a in classify.EXACT)
_LANGUAGE_ROWS = ", ".join(f"('{e}', '{n}', '{c}', '{t}', '{a}')" for n, x, c, t, a in classify.LANGUAGES for e in x.split())
CLASSES = f"""{F_}, exact(name, category, format, tier, analyzer, policy) AS (VALUES {_CLASS_ROWS}), langs(ext, format, category, tier, analyzer) AS (VALUES {_LANGUAGE_ROWS}),
named AS (SELECT *, {NAME} AS name, {EXT} AS ext, string_split(path, '/') AS parts, {GENERATED} AS marked FROM files),
classed AS (SELECT n.*, list_contains(parts, 'generated') OR marked AS generated,
  CASE WHEN e.name IS NOT NULL THEN [e.category, e.format, e.tier, e.analyzer, e.policy]
       WHEN starts_with(path, '.github/workflows/') THEN ['ContinuousIntegration', 'github-actions', 'StructuredFormat', 'Structured', 'Allowed']
       WHEN list_contains(parts, 'migrations') THEN ['DatabaseMigration', coalesce(l.format, n.ext), coalesce(l.tier, 'GenericText'), coalesce(l.analyzer, 'GenericText'), 'Allowed']
       WHEN n.ext IN ('svg', 'png', 'jpg', 'jpeg', 'gif', 'webp', 'ico') THEN ['StaticAsset', n.ext, 'GenericText', 'GenericText', 'ExcerptOnly']
       WHEN l.ext IS NOT NULL THEN [l.category, l.format, l.tier, l.analyzer, 'Allowed']
       WHEN starts_with(content, '#!') AND contains(string_split(content, chr(10))[1], 'sh') THEN ['Script', 'shell', 'GenericText', 'GenericText', 'Allowed']
       ELSE ['UnknownText', NULL, 'GenericText', 'GenericText', 'Allowed'] END AS c
  FROM named n LEFT JOIN exact e ON e.name = n.name LEFT JOIN langs l ON l.ext = n.ext),
kinds AS (SELECT *, CASE WHEN generated THEN 'GeneratedSource' ELSE c[1] END AS category, c[2] AS format, CASE WHEN generated THEN 100 ELSE 0 END AS generated_score, CASE WHEN NOT generated AND list_contains(parts, 'vendor') THEN 100 ELSE 0 END AS vendored_score, {SECRET} AS secret FROM classed),
gated AS (SELECT *, CASE WHEN secret OR size_bytes > 1000000 OR vendored_score >= 100 THEN 'Opaque' ELSE c[3] END AS tier, CASE WHEN secret OR size_bytes > 1000000 OR vendored_score >= 100 THEN 'Opaque' ELSE c[4] END AS analyzer,
  CASE WHEN secret THEN 'Never' WHEN (size_bytes > 1000000 OR vendored_score >= 100) AND c[5] = 'Allowed' THEN 'ExcerptOnly' ELSE c[5] END AS policy FROM kinds)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classified(files(spark, sf_dir))


@query(f"WITH {CLASSES} SELECT path, category, format, generated_score, vendored_score, tier, analyzer, policy FROM gated")
def classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).drop("k", "size_bytes", "content")


@query(f"WITH {CLASSES} SELECT path, CASE WHEN policy = 'Never' THEN 'ModelExcluded' WHEN {SECRET} THEN 'Redacted' WHEN vendored_score >= 100 THEN 'Excluded' WHEN size_bytes >= 1000000 THEN 'OverLimit' WHEN trim(content) = '' THEN 'Empty' END AS reason FROM gated")
def chunk_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified(spark, sf_dir)
    reason = classify.skip_reason(F.col("policy") == "Never", F.lit(False), classify.is_secret_path(F.col("path")), F.col("vendored_score") >= 100, F.col("size_bytes"), F.col("content"))
    return rows.select("path", reason.alias("reason"))


@query(f"WITH {CLASSES} SELECT path, CASE WHEN lower(name) = '.env' OR starts_with(lower(name), '.env.') THEN 'Environment' WHEN analyzer = 'Specialized' THEN CASE format WHEN 'python' THEN 'Python' WHEN 'rust' THEN 'Rust' WHEN 'typescript' THEN 'TypeScript' WHEN 'tsx' THEN 'TypeScript' WHEN 'requirements-txt' THEN 'Requirements' WHEN 'protobuf' THEN 'Protocol' ELSE 'PackageManifest' END WHEN analyzer = 'Structured' THEN CASE WHEN format = 'dockerfile' THEN 'Dockerfile' WHEN format = 'markdown' THEN 'Markdown' WHEN format = 'docker-compose' THEN 'Compose' WHEN format = 'github-actions' THEN 'Actions' WHEN name = 'Cargo.toml' THEN 'Cargo' WHEN name = 'pyproject.toml' THEN 'PyProject' WHEN format IN ('yaml', 'json', 'toml') THEN 'Structured' END WHEN analyzer IN ('SyntaxIndexed', 'GenericText') THEN analyzer END AS kind FROM gated")
def analyzers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("path", classify.analyzer(F.col("path"), F.col("format"), F.col("analyzer")).alias("kind"))


@query(f"WITH {CLASSES} SELECT coalesce(format, 'none') AS language, count(*) AS n, max(CASE tier WHEN 'DeepLanguage' THEN 3 WHEN 'StructuredFormat' THEN 2 WHEN 'GenericText' THEN 1 ELSE 0 END)::INTEGER AS best_tier FROM gated GROUP BY 1")
def language_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of each language, and the best tier that one of them has."""
    tier = F.when(F.col("tier") == "DeepLanguage", 3).when(F.col("tier") == "StructuredFormat", 2).when(F.col("tier") == "GenericText", 1).otherwise(0)
    return classified(spark, sf_dir).groupBy(F.coalesce("format", F.lit("none")).alias("language")).agg(F.count(F.lit(1)).alias("n"), F.max(tier).alias("best_tier"))


LAYER_SQL = "CASE " + " ".join(
    f"WHEN len(list_intersect(string_split(lower(path), '/'), [{', '.join(repr(w) for w in words)}])) > 0 OR regexp_matches(lower(path), '(^|/)({c})[_\\-.][^/]*$|(^|/)[^/]*[_\\-]({c})(\\.[^/]*)?$|(^|/)({c})\\.[^/]*$') THEN '{name}'"
    for name, words in paths.LAYERS
    for c in ["|".join(w.replace(".", "\\.") for w in words)]
) + " END"


@query(f"WITH {CLASSES} SELECT path, coalesce({LAYER_SQL}, CASE WHEN category IN ('ContainerDefinition', 'ContinuousIntegration', 'BuildDefinition') THEN 'Infra' WHEN category = 'DatabaseMigration' THEN 'Data' WHEN category = 'ApiSchema' THEN 'Api' WHEN category = 'TestData' THEN 'Test' END, CASE WHEN contains(content, '/api/') THEN 'Api' ELSE 'Unknown' END) AS layer FROM gated")
def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By path, else by category, else by whether it has a route."""
    rows = classified(spark, sf_dir)
    return rows.select("path", paths.layer_of(F.col("path"), F.col("category"), F.col("content").contains("/api/")).alias("layer"))


@query(f"WITH {CLASSES} SELECT path, CASE WHEN category = 'Documentation' OR len(list_intersect(string_split(lower(path), '/'), ['doc', 'docs', 'documentation'])) > 0 THEN 'DocumentationExample' WHEN category IN ('BuildDefinition', 'ContinuousIntegration') THEN 'BuildAutomation' ELSE 'Executable' END AS provenance FROM gated")
def command_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("path", classify.command_provenance(F.col("path"), F.col("category")).alias("provenance"))


@query(f"WITH {F_} SELECT path, unnest(CASE WHEN content = '' THEN ['0'] ELSE ['1'] END) AS has FROM files WHERE regexp_matches(path, '^docs/(?:.*/)?guide[^/]*\\.md$') OR regexp_matches(path, '^(?:src|go)/.*\\.[mr].$')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by two globs."""
    path = F.col("path")
    hit = path.rlike(paths.glob_pattern("docs/**/guide*.md")) | path.rlike(paths.glob_pattern("{src,go}/*.[mr]?"))
    return files(spark, sf_dir).where(hit).select("path", F.when(F.col("content") == "", "0").otherwise("1").alias("has"))


MD = f"{L_}, mlines AS (SELECT *, starts_with(ltrim(text), '```') AS fence, coalesce(sum(starts_with(ltrim(text), '```')::INTEGER) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS inside FROM flines WHERE ends_with(path, '.md'))"


def documents_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(F.col("path").endswith(".md"))


@query(f"WITH {MD} SELECT path, line, length(regexp_extract(text, '^(#+)', 1))::INTEGER AS level, regexp_extract(text, '^#+\\s+(.*)$', 1) AS title FROM mlines WHERE NOT fence AND inside = 0 AND regexp_matches(text, '^#{{1,6}}\\s+\\S')")
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.headings(documents_(spark, sf_dir))


MLINKS = MD + ", m AS (SELECT path, line, unnest(regexp_extract_all(text, '!?\\[[^\\]]*\\]\\([^)\\s]+[^)]*\\)')) AS link FROM mlines WHERE NOT fence AND inside = 0), ml AS (SELECT path, line, CASE WHEN starts_with(link, '!') THEN 'image' ELSE 'link' END AS kind, regexp_extract(link, '\\[([^\\]]*)\\]', 1) AS label, regexp_extract(link, '\\(([^)\\s]+)', 1) AS target FROM m), mr AS (SELECT *, CASE WHEN starts_with(target, 'https:') THEN NULL WHEN starts_with(target, '../../') THEN substr(target, 7) ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || target END AS resolved FROM ml)"


@query(f"WITH {MLINKS} SELECT path, line, kind, label, target, resolved, EXISTS (SELECT 1 FROM files f WHERE f.path = resolved) AS there FROM mr")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and images, the file they name, and whether it is there."""
    rows = extract.links(documents_(spark, sf_dir))
    have = files(spark, sf_dir).select(F.col("path").alias("resolved"), F.lit(True).alias("there"))
    return rows.join(have, "resolved", "left").select("path", "line", "kind", "label", "target", "resolved", F.coalesce("there", F.lit(False)).alias("there"))


@query(f"WITH {MD} SELECT path, line, text AS command FROM mlines WHERE NOT fence AND inside = 1")
def markdown_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.commands(documents_(spark, sf_dir))


DRIFT = MLINKS + """, refs AS (SELECT DISTINCT path, line, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '!?\\[[^\\]]*\\]\\([^)\\s]+[^)]*\\)', ' ', 'g'), '[A-Za-z][A-Za-z0-9+.\\-]*://\\S*', ' ', 'g'), '(?:[A-Za-z0-9_.\\-]+/)+[A-Za-z0-9_\\-]+\\.[A-Za-z0-9]+')) AS reference FROM mlines WHERE NOT fence AND inside = 0),
targets AS (SELECT DISTINCT regexp_extract(text, '^([A-Za-z0-9_.\\-]+)\\s*:', 1) AS target FROM flines WHERE ends_with(path, '/Makefile') AND regexp_matches(text, '^[A-Za-z0-9_.\\-]+\\s*:([^=]|$)')),
drift AS (SELECT path, line, 'BrokenLink' AS rule, target AS subject FROM mr WHERE resolved IS NOT NULL AND resolved NOT IN (SELECT path FROM files)
UNION ALL SELECT path, line, 'MissingPath', reference FROM refs WHERE reference NOT IN (SELECT path FROM files)
UNION ALL SELECT path, line, 'StaleCommand', text FROM mlines WHERE NOT fence AND inside = 1 AND regexp_matches(text, '^make\\s+\\S') AND regexp_extract(text, '^make\\s+(\\S+)', 1) NOT IN (SELECT target FROM targets)
UNION ALL SELECT path, line, 'UnresolvedIntent', substr(trim(text), 1, 160) FROM mlines WHERE NOT fence AND inside = 0 AND regexp_matches(lower(text), 'todo|fixme|not yet implemented|not implemented|coming soon|planned|will support|should support')
UNION ALL SELECT path, line, 'UndocumentedRoute', route FROM (SELECT path, line, unnest(regexp_extract_all(text, '/api/[a-z]+')) AS route FROM flines WHERE ends_with(path, '.md')) WHERE false)"""


@query(f"WITH {DRIFT} SELECT path, line, rule, subject FROM drift")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents and files disagree: broken links, missing paths, commands without a target, work still to be done."""
    return findings.drift(documents_(spark, sf_dir), files(spark, sf_dir))


@query(f"WITH {L_}, r AS (SELECT DISTINCT '/api/' || regexp_extract(path, '^api/routes/([a-z]+)', 1) AS route FROM files WHERE starts_with(path, 'api/routes/')), extra AS (SELECT route FROM r UNION ALL SELECT '/api/hidden'), d AS (SELECT lower(text) AS text FROM flines WHERE ends_with(path, '.md')) SELECT route FROM extra WHERE NOT EXISTS (SELECT 1 FROM d WHERE contains(text, lower(route)))")
def undocumented_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that no document mentions."""
    rows = files(spark, sf_dir)
    made = rows.where(F.col("path").startswith("api/routes/")).select(F.concat(F.lit("/api/"), F.regexp_extract("path", "^api/routes/([a-z]+)", 1)).alias("route")).distinct()
    hidden = spark.range(1).select(F.lit("/api/hidden").alias("route"))
    return findings.unmentioned(made.unionByName(hidden), "route", extract.lines_of(documents_(spark, sf_dir)))


@query(f"WITH {L_}, s AS (SELECT path, line, upper(regexp_extract(text, '^([A-Z]+)', 1)) AS instruction, trim(regexp_extract(text, '^[A-Z]+(.*)$', 1)) AS arguments FROM flines WHERE ends_with(path, '/Dockerfile')) SELECT path, line::INTEGER AS step, instruction, arguments, sum((instruction = 'FROM')::INTEGER) OVER (PARTITION BY path ORDER BY line) AS stage, CASE WHEN sum((instruction = 'FROM')::INTEGER) OVER (PARTITION BY path ORDER BY line) = 1 THEN 'build' ELSE '' END AS stage_name FROM s")
def container_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.container_steps(files(spark, sf_dir).where(F.col("path").endswith("/Dockerfile")))


@query(f"WITH {L_}, a AS (SELECT path, line, regexp_extract(text, '^(?:export )?([A-Z_]+)=', 1) AS key, regexp_replace(regexp_extract(text, '=(.*)$', 1), '^\"(.*)\"$', '\\1') AS value FROM flines WHERE contains(path, '/.env') AND NOT starts_with(text, '#')) SELECT path, line, key, value, array_to_string(regexp_extract_all(value, '\\$\\{{([A-Z_]+)', 1), ',') AS placeholders FROM a")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.assignments(files(spark, sf_dir).where(F.col("path").contains("/.env")))
    return rows.withColumn("placeholders", F.array_join("placeholders", ","))


@query(f"WITH {L_} SELECT path, line, regexp_extract(first_value(text) OVER (PARTITION BY path ORDER BY line), 'service (\\w+)', 1) AS service, regexp_extract(text, 'rpc (\\w+) \\(', 1) AS rpc FROM flines WHERE ends_with(path, '.proto') QUALIFY regexp_matches(text, '^\\s+rpc \\w+ \\(')")
def protocol_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.protocol_calls(files(spark, sf_dir).where(F.col("path").endswith(".proto")))


@query(f"WITH {L_} SELECT path, line, regexp_replace(lower(regexp_extract(text, '^([A-Za-z0-9_]+)', 1)), '_+', '-', 'g') AS package, trim(regexp_extract(text, '^[A-Za-z0-9_]+(?:\\[[^\\]]*\\])?([^#]*)', 1)) AS specifier FROM flines WHERE ends_with(path, '/requirements.txt') AND regexp_matches(text, '^[A-Za-z]')")
def required_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.requirements(files(spark, sf_dir).where(F.col("path").endswith("/requirements.txt")))


@query(f"WITH {L_}, g AS (SELECT *, regexp_extract(first_value(text) OVER (PARTITION BY path ORDER BY line), 'module (\\S+)', 1) AS module FROM flines WHERE ends_with(path, '/go.mod')) SELECT path, module, regexp_extract(text, '(\\S+) v', 1) AS package, regexp_extract(text, ' (v\\S+)', 1) AS version, contains(text, 'indirect') AS indirect FROM g WHERE regexp_matches(text, ' v[0-9]')")
def go_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.go_modules(files(spark, sf_dir).where(F.col("path").endswith("/go.mod")))


@query(f"WITH {F_}, j AS (SELECT path, content::JSON AS c FROM files WHERE ends_with(path, '/package.json')) SELECT path, '' AS config_path, 'Object' AS kind, NULL AS value FROM j UNION ALL SELECT path, 'name', 'String', c->>'$.name' FROM j UNION ALL SELECT path, 'version', 'String', c->>'$.version' FROM j UNION ALL SELECT path, 'dependencies', 'Object', NULL FROM j UNION ALL SELECT path, 'dependencies.' || key, 'String', c->'dependencies'->>key FROM (SELECT path, c, unnest(json_keys(c, '$.dependencies')) AS key FROM j) UNION ALL SELECT path, 'tags', 'Array', NULL FROM j UNION ALL SELECT path, 'tags[0]', 'String', c->>'$.tags[0]' FROM j UNION ALL SELECT path, 'tags[1]', 'String', c->>'$.tags[1]' FROM j")
def structured_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.structured(files(spark, sf_dir).where(F.col("path").endswith("/package.json")))


@query(f"WITH {F_}, j AS (SELECT path, content::JSON AS c FROM files WHERE ends_with(path, '/package.json')) SELECT path, 'dependencies' AS scope, key AS package, c->'dependencies'->>key AS version FROM (SELECT path, c, unnest(json_keys(c, '$.dependencies')) AS key FROM j)")
def manifest_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.manifest_packages(extract.structured(files(spark, sf_dir).where(F.col("path").endswith("/package.json"))))


@query(f"WITH {F_}, y AS (SELECT k, path, content FROM files WHERE starts_with(path, '.github/workflows/')) SELECT path, 'build' AS job, 0 AS step, regexp_extract(content, 'run: (.*)$', 1) AS run, regexp_extract(content, 'build -t (\\S+)', 1) AS image, false AS pushes FROM y")
def workflow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.workflow_steps(extract.structured(files(spark, sf_dir).where(F.col("path").startswith(".github/workflows/")))).drop("uses")


@query("SELECT event_id, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events WHERE CAST(props::JSON->>'$.k' AS BIGINT) % 10 = 7")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value out of JSON text."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))
    return rows.where("k % 10 = 7")


@query(f"WITH {F_}, p AS (SELECT path, string_split(path, '/') AS x FROM files), t AS (SELECT path, array_to_string(x[1:i], '/') AS node, i, i = len(x) AS is_file FROM (SELECT path, x, unnest(range(1, len(x) + 1)) AS i FROM p)), d AS (SELECT DISTINCT node, is_file, i AS depth FROM t) SELECT node AS path, CASE WHEN contains(node, '/') THEN regexp_extract(node, '^(.*)/[^/]*$', 1) END AS parent, regexp_extract(node, '[^/]*$') AS name, NOT is_file AS is_dir, depth::INTEGER AS depth FROM d")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folders and files."""
    return planning.file_tree(files(spark, sf_dir))


AREA = "CASE WHEN string_split(path, '/')[1] IN ('src', 'apps', 'packages', 'services', 'crates') AND len(string_split(path, '/')) > 2 THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END"


@query(f"WITH {F_}, a AS (SELECT k, {AREA} AS area FROM files), e AS (SELECT a.k AS s, b.k AS t, a.area AS x, b.area AS y FROM a JOIN a b ON b.k = a.k + 1), c AS (SELECT area, count(*) AS n_files FROM a GROUP BY area) SELECT c.area, n_files, (SELECT count(*) FROM e WHERE x = c.area AND y <> c.area) AS outgoing, (SELECT count(*) FROM e WHERE y = c.area AND x <> c.area) AS incoming, (SELECT count(DISTINCT CASE WHEN x = c.area THEN y ELSE x END) FROM e WHERE x <> y AND (x = c.area OR y = c.area)) AS connected FROM c")
def repository_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and links of each area; here each file is linked to the next."""
    rows = files(spark, sf_dir)
    nodes = rows.select(F.col("k").cast("string").alias("id"), "path")
    edges = rows.select(F.col("k").cast("string").alias("source"), (F.col("k") + 1).cast("string").alias("target"))
    return planning.areas(nodes, edges.join(nodes.select(F.col("id").alias("target")), "target", "left_semi"))


BUCKETS = f"{CLASSES}, b AS (SELECT *, CASE WHEN starts_with(path, 'crates/') OR starts_with(path, 'services/') THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] WHEN category IN ('Documentation', 'ContinuousIntegration') THEN category ELSE string_split(path, '/')[1] END AS bucket FROM gated)"


@query(f"WITH {BUCKETS}, s AS (SELECT bucket, count(*) AS members, sum(ceil(size_bytes / 3.5))::BIGINT AS tokens, sha256(string_agg(path, chr(10) ORDER BY path)) AS digest FROM b GROUP BY bucket), r AS (SELECT *, row_number() OVER (ORDER BY members DESC, bucket) AS place, count(*) OVER () AS n FROM s) SELECT bucket, members, tokens, digest, (CASE WHEN n <= 40 OR place < 40 THEN bucket ELSE 'other' END) AS module FROM r")
def planned_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of files, and the modules they are merged into so that there are forty at most."""
    rows = classified(spark, sf_dir)
    return planning.modules(rows.withColumn("bucket", planning.bucket_of(F.col("path"), F.col("category"))), 40)


@query(f"WITH {BUCKETS}, h AS (SELECT bucket AS page, sha256(string_agg(path || ':' || sha256(content), chr(10) ORDER BY path)) AS digest FROM b GROUP BY bucket), o AS (SELECT bucket AS page, sha256(string_agg(path || ':' || sha256(content), chr(10) ORDER BY path)) AS digest FROM b WHERE k % 97 <> 5 GROUP BY bucket) SELECT coalesce(h.page, o.page) AS page, CASE WHEN o.page IS NULL THEN 'new' WHEN h.page IS NULL THEN 'removed' WHEN h.digest <> o.digest THEN 'stale' ELSE 'fresh' END AS state FROM h FULL JOIN o ON h.page = o.page")
def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages are stale against a manifest of fewer files."""
    rows = classified(spark, sf_dir)
    rows = rows.select("k", planning.bucket_of(F.col("path"), F.col("category")).alias("page"), "path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    return planning.stale_pages(planning.page_inputs(rows.where("k % 97 <> 5")), planning.page_inputs(rows))


@query(f"WITH {BUCKETS} SELECT DISTINCT bucket AS page FROM b WHERE k IN (5, 18, 31, 400)")
def affected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a changed member."""
    rows = classified(spark, sf_dir)
    members = rows.select(planning.bucket_of(F.col("path"), F.col("category")).alias("page"), F.col("k").cast("string").alias("id"))
    changed = spark.range(1).select(F.explode(F.array(*map(F.lit, ("5", "18", "31", "400")))).alias("id"))
    return planning.affected_pages(members, changed)


@query(f"WITH {F_}, i AS (SELECT path, CASE k % 3 WHEN 0 THEN './lib' || (k // 26 * 26 + 1) WHEN 1 THEN '../' || string_split(path, '/')[2] || '/lib' || k ELSE './none' END AS spec FROM files WHERE k % 26 = 1), r AS (SELECT path, spec, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] || '/' || regexp_extract(spec, '[^/]*$') || '.rs' AS target FROM i) SELECT path, spec, CASE WHEN target IN (SELECT path FROM files) THEN target END AS target FROM r")
def import_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that an import without an ending names."""
    rows = files(spark, sf_dir)
    whole = F.call_function("div", F.col("k"), F.lit(26)) * 26 + 1
    folder = F.element_at(F.split("path", "/"), 2)
    spec = F.when(F.col("k") % 3 == 0, F.concat(F.lit("./lib"), whole.cast("string"))).when(F.col("k") % 3 == 1, F.concat(F.lit("../"), folder, F.lit("/lib"), F.col("k").cast("string"))).otherwise("./none")
    imports = rows.where("k % 26 = 1").select("path", spec.alias("spec"))
    return resolve.import_targets(imports, rows.select("path"), (".rs", ".ts", "/mod.rs"))


@query(f"WITH {F_}, r AS (SELECT k, CASE k % 4 WHEN 0 THEN '@acme/kit' || (k % 7) || '/sub/x' WHEN 1 THEN 'react/jsx' WHEN 2 THEN 'github.com/acme/cold/v2/pkg' ELSE './local' END AS spec FROM files) SELECT k, spec, CASE k % 4 WHEN 0 THEN '@acme/kit' || (k % 7) WHEN 1 THEN 'react' WHEN 2 THEN 'github.com' END AS root FROM r")
def package_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    spec = F.when(k % 4 == 0, F.concat(F.lit("@acme/kit"), (k % 7).cast("string"), F.lit("/sub/x"))).when(k % 4 == 1, "react/jsx").when(k % 4 == 2, "github.com/acme/cold/v2/pkg").otherwise("./local")
    return files(spark, sf_dir).select("k", spec.alias("spec")).withColumn("root", resolve.package_root(F.col("spec")))


@query(f"WITH {F_}, m AS (SELECT DISTINCT 'github.com/acme/' || split_part(p_name, ' ', 1) AS module FROM part), r AS (SELECT p_partkey AS k, 'github.com/acme/' || split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '/pkg' || p_size END AS spec FROM part) SELECT k, spec, (SELECT module FROM m WHERE spec = module OR starts_with(spec, module || '/') ORDER BY length(module) DESC LIMIT 1) AS module FROM r")
def module_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest module that an import path is in."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    module = F.concat(F.lit("github.com/acme/"), F.split_part("p_name", F.lit(" "), F.lit(1)))
    refs = part.select(F.col("p_partkey").alias("k"), F.concat(module, F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.concat(F.lit("/pkg"), F.col("p_size").cast("string")))).alias("spec"))
    return resolve.longest_prefix(refs, part.select(module.alias("module")).distinct(), "spec", "module")


@query(f"WITH {F_}, c AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files WHERE ends_with(path, '/tsconfig.json')), r AS (SELECT path AS file, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/src/a' || k || '.ts' AS src, '@' || (k % 3) || '/ui/b' || k AS spec, k FROM files WHERE ends_with(path, '/tsconfig.json')) SELECT src AS path, spec, CASE k % 3 WHEN 0 THEN regexp_extract(file, '^(.*)/[^/]*$', 1) || '/./lib/zero/ui/b' || k WHEN 1 THEN regexp_extract(file, '^(.*)/[^/]*$', 1) || '/./lib/one-ui/b' || k END AS target FROM r")
def alias_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports under path aliases: the nearest folder with settings, the longest pattern."""
    rows = files(spark, sf_dir).where(F.col("path").endswith("/tsconfig.json"))
    folder = paths.parent(F.col("path"))
    rule = lambda p, t: F.struct(F.lit(p).alias("pattern"), F.lit(t).alias("target"))
    aliases = rows.select(folder.alias("folder"), F.lit(".").alias("base_url"), F.explode(F.array(rule("@0/*", "lib/zero/*"), rule("@1/*", "lib/one/*"), rule("@1/ui/*", "lib/one-ui/*"))).alias("x")).select("folder", "base_url", "x.*")
    k = F.col("k").cast("string")
    imports = rows.select(F.concat(folder, F.lit("/src/a"), k, F.lit(".ts")).alias("path"), F.concat(F.lit("@"), (F.col("k") % 3).cast("string"), F.lit("/ui/b"), k).alias("spec"))
    return resolve.alias_targets(imports, aliases)


@query(f"WITH {F_}, d AS (SELECT path, md5(regexp_replace(regexp_replace(content, '(?s)(-----BEGIN [^\\n]*PRIVATE KEY-----\\n)[^\\n]*(\\n-----END)', '\\1[REDACTED]\\2', 'g'), '(?m)^((?:export )?[A-Z_]*(?:PASSWORD|TOKEN|SECRET)[A-Z_]*)=.*$', '\\1= [REDACTED]', 'g')) AS digest FROM files WHERE contains(path, '/.env') OR ends_with(path, '.pem')) SELECT * FROM d")
def redacted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of secret keys and the lines of private-key blocks are masked."""
    rows = files(spark, sf_dir).where(F.col("path").contains("/.env") | F.col("path").endswith(".pem"))
    return rows.select("path", F.md5(findings.redact_text(F.col("content")).cast("binary")).alias("digest"))


@query(f"WITH {L_}, p AS (SELECT path, line, regexp_extract(text, '^// (NOTE|TODO)(?:\\(([^)]*)\\))?: (.*)$', ['word', 'owner', 'note']) AS x FROM flines WHERE ends_with(path, '.rs') AND starts_with(text, '// ')) SELECT path, line, CASE x.word WHEN 'NOTE' THEN 'Note' ELSE 'Todo' END AS kind, x.owner AS owner, x.note AS note FROM p")
def rationale_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that say why, by kind, with owner and note."""
    lines = extract.lines_of(files(spark, sf_dir).where(F.col("path").endswith(".rs"))).withColumnRenamed("path", "doc_id")
    return findings.rationale(lines).withColumnRenamed("doc_id", "path")


@query(f"WITH {L_}, i AS (SELECT path, line, substr(trim(text), 1, 160) AS excerpt, 'todo' AS keyword FROM flines WHERE contains(lower(text), 'todo')) SELECT path, line, keyword, excerpt FROM i")
def intent_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = extract.lines_of(files(spark, sf_dir)).withColumnRenamed("path", "doc_id")
    return findings.intent_lines(lines).withColumnRenamed("doc_id", "path")


@query(f"WITH {F_} SELECT path, 'Image' AS kind, 'rust:1.' || (k % 90) AS value, 1 AS line FROM files WHERE ends_with(path, '/Dockerfile') UNION ALL SELECT path, 'Image', 'debian:12', 6 FROM files WHERE ends_with(path, '/Dockerfile') UNION ALL SELECT path, 'Route', '/app', 3 FROM files WHERE ends_with(path, '/Dockerfile') UNION ALL SELECT path, 'EnvVar', 'LOG_LEVEL', 7 FROM files WHERE false UNION ALL SELECT path, 'Route', regexp_extract(content, '--from=build (\\S+)', 1), 8 FROM files WHERE ends_with(path, '/Dockerfile') UNION ALL SELECT path, 'Route', regexp_extract(content, 'CMD (\\S+)', 1), l FROM files, (VALUES (8), (10)) v(l) WHERE ends_with(path, '/Dockerfile')")
def generic_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.generic_facts(files(spark, sf_dir).where(F.col("path").endswith("/Dockerfile")))


@query(f"WITH {F_}, e AS (SELECT k, path || '#L' || (1 + k % 4) || CASE WHEN k % 3 = 0 THEN '-L' || (k % 5) ELSE '' END AS ref FROM files WHERE k % 26 IN (0, 1, 4) UNION ALL SELECT -1, 'no/such.rs#L1' UNION ALL SELECT -2, 'broken'), p AS (SELECT k, ref, regexp_extract(ref, '^(.+)#L(\\d+)(?:-L(\\d+))?$', ['path', 'a', 'b']) AS x FROM e), v AS (SELECT p.k, ref, x.path <> '' AS ok, x.a AS a, CASE WHEN x.b = '' THEN x.a ELSE x.b END AS b, f.path AS fpath, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END AS n FROM p LEFT JOIN files f ON f.path = x.path) SELECT ref, CASE WHEN NOT ok THEN 'malformed' WHEN fpath IS NULL THEN 'unknown_path' WHEN a::INT < 1 OR b::INT < a::INT OR b::INT > n THEN 'bad_lines' ELSE 'valid' END AS state FROM v")
def evidence_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References path#Lx-Ly against the files."""
    rows = files(spark, sf_dir)
    k = F.col("k")
    tail = F.when(k % 3 == 0, F.concat(F.lit("-L"), (k % 5).cast("string"))).otherwise("")
    refs = rows.where("k % 26 IN (0, 1, 4)").select(F.concat("path", F.lit("#L"), (1 + k % 4).cast("string"), tail).alias("ref"))
    odd = spark.range(1).select(F.explode(F.array(F.lit("no/such.rs#L1"), F.lit("broken"))).alias("ref"))
    _, _, n = read_facts(F.col("content").cast("binary"))
    return findings.checked_references(refs.unionByName(odd), rows.select("path", n.alias("n_lines")))


@query(f"WITH {F_}, s AS (SELECT path, CASE k % 2 WHEN 0 THEN 'def a' ELSE 'struct' END AS name FROM files WHERE k % 26 = 1), b AS (SELECT * FROM (VALUES ('print', 'python'), ('len', 'python'), ('println', 'rust'), ('vec', 'rust')) AS t(name, language)), u AS (SELECT k, CASE k % 4 WHEN 0 THEN 'println' WHEN 1 THEN 'len' WHEN 2 THEN 'vec' ELSE 'custom' END AS name, CASE WHEN k % 2 = 0 THEN 'rust' ELSE 'python' END AS language FROM files) SELECT u.k, u.name, u.language, CASE WHEN b.name IS NOT NULL THEN 'External' ELSE 'Unresolved' END AS label, CASE WHEN b.name IS NOT NULL THEN 'package:' || u.language || '-builtins' END AS package FROM u LEFT JOIN b ON b.name = u.name AND b.language = u.language")
def builtin_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved names that a language brings along become external."""
    k = F.col("k")
    name = F.when(k % 4 == 0, "println").when(k % 4 == 1, "len").when(k % 4 == 2, "vec").otherwise("custom")
    refs = files(spark, sf_dir).select("k", name.alias("name"), F.when(k % 2 == 0, "rust").otherwise("python").alias("language"))
    known = spark.createDataFrame([("print", "python"), ("len", "python"), ("println", "rust"), ("vec", "rust")], "name string, language string")
    return resolve.builtins(refs, known)


@query(f"WITH {F_}, o AS (SELECT path AS key, sha256(content) AS digest FROM files WHERE k % 10 <> 3), n AS (SELECT path AS key, sha256(content) AS digest FROM files WHERE k % 11 <> 4) SELECT coalesce(n.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'computed' WHEN n.key IS NULL THEN 'dropped' ELSE 'reused' END AS action FROM n FULL JOIN o ON n.key = o.key")
def cached_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a content-addressed cache gives back, what is computed and what is dropped."""
    rows = files(spark, sf_dir).select("k", F.col("path").alias("key"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    return relational.cache_plan(rows.where("k % 11 <> 4").drop("k"), rows.where("k % 10 <> 3").drop("k"))


@query(f"WITH {F_} SELECT path, 'Import' AS kind, 'os' AS name, 1 AS first, 1 AS last FROM files WHERE k % 26 = 2 UNION ALL SELECT path, 'Function', regexp_extract(content, 'def (\\w+)', 1), 2, 3 FROM files WHERE k % 26 = 2")
def python_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and imports of Python files."""
    return syntax.python_facts(files(spark, sf_dir).where(F.col("path").endswith(".py"))).select("path", "kind", "name", "first", "last")


@query(f"WITH {F_}, e AS (SELECT 'Contains' AS kind, 'artifact:' || path AS source, 'symbol:' || path || '#' || regexp_extract(content, 'def (\\w+)', 1) AS target FROM files WHERE k % 26 = 2 UNION ALL SELECT 'Imports', 'artifact:' || path, 'unresolved:os' FROM files WHERE k % 26 = 2) SELECT kind || '|' || source || '|' || target AS id, source, target, kind FROM e")
def python_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.python_edges(syntax.python_facts(files(spark, sf_dir).where(F.col("path").endswith(".py"))))


@query(f"WITH {F_} SELECT path, 'Function' AS kind, regexp_extract(content, 'fn (\\w+)', 1) AS name, 2 AS line FROM files WHERE k % 26 = 1")
def pattern_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of other languages by pattern."""
    return syntax.pattern_facts(files(spark, sf_dir))
