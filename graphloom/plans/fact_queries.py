"""Queries over the facts of files of many formats, and the edges that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import classify
from graphloom.operators import facts
from graphloom.plans.registry import query
from graphloom.sources.files import STACKS, stack_files

#: The files of STACKS by lines; t is the format.
LINES = (
    "files AS ("
    + STACKS.replace("{part}", "part")
    + """), l AS (
  SELECT k, k % 11 AS t, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files
), md AS (
  SELECT *, sum(fence::INT) OVER w AS f, last_value(CASE WHEN fence THEN lower(regexp_extract(text, '^(`{3,}|~{3,})\\s*(\\w*)', 2)) END IGNORE NULLS) OVER w AS lang
  FROM (SELECT *, regexp_matches(text, '^(`{3,}|~{3,})') AS fence FROM l WHERE t = 0) WINDOW w AS (PARTITION BY path ORDER BY line)
), dk AS (
  SELECT path, min(line) AS line, string_agg(regexp_replace(text, '\\\\$', ''), ' ' ORDER BY line) AS text FROM (
    SELECT *, sum(CASE WHEN ends_with(before, chr(92)) THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line) AS g FROM (
      SELECT *, coalesce(lag(text) OVER (PARTITION BY path ORDER BY line), '') AS before FROM l WHERE t = 1 AND NOT starts_with(text, '#'))) GROUP BY path, g
), ym AS (
  SELECT *, last_value(nullif(regexp_extract(text, '^(\\w+):', 1), '') IGNORE NULLS) OVER w AS top, last_value(nullif(regexp_extract(text, '^  (\\w+):', 1), '') IGNORE NULLS) OVER w AS two,
         last_value(nullif(regexp_extract(text, '^    (\\w+):', 1), '') IGNORE NULLS) OVER w AS four, sum(starts_with(text, '      - ')::INT) OVER w AS item
  FROM l WHERE t IN (2, 3) AND NOT EXISTS (SELECT 1 FROM l AS o WHERE o.path = l.path AND ends_with(o.text, '[')) WINDOW w AS (PARTITION BY path ORDER BY line)
), tm AS (
  SELECT *, last_value(nullif(regexp_extract(text, '^\\[(.*)\\]$', 1), '') IGNORE NULLS) OVER w AS part,
         last_value(nullif(regexp_extract(text, '^  "(\\w+)": \\{$', 1), '') IGNORE NULLS) OVER w AS obj FROM l WHERE t IN (4, 5, 6) WINDOW w AS (PARTITION BY path ORDER BY line)
), own AS (
  SELECT path, regexp_extract(text, 'name"? ?[=:] "([^"]*)"', 1) AS name FROM tm WHERE regexp_matches(text, '^(name = |  "name": )')
  UNION ALL SELECT path, substr(text, 8) FROM l WHERE t = 10 AND starts_with(text, 'module ')
), used AS (
  SELECT path, regexp_extract(text, '^(\\w+) = ', 1) AS name FROM tm WHERE t = 4 AND part LIKE '%dependencies' AND regexp_matches(text, '^\\w+ = ')
  UNION ALL SELECT path, regexp_replace(lower(regexp_extract(text, '^  "(\\w+)', 1)), '[_.]+', '-', 'g') FROM tm WHERE t = 5 AND starts_with(text, '  "')
  UNION ALL SELECT path, regexp_extract(text, '^    "([^"]+)"', 1) FROM tm WHERE t = 6 AND obj ILIKE '%dependencies' AND starts_with(text, '    "')
  UNION ALL SELECT path, regexp_replace(lower(regexp_extract(text, '^[A-Za-z][\\w.]*', 0)), '[_.]+', '-', 'g') FROM l WHERE t = 9 AND regexp_matches(text, '^[A-Za-z]')
  UNION ALL SELECT path, regexp_extract(text, '^(require |  )(\\S+) v', 2) FROM l WHERE t = 10 AND regexp_matches(text, '^(require |  )\\S+ v')
)"""
)
EDGE_SQL = f"""
WITH {LINES}, refs AS (
  SELECT path, regexp_replace(unnest(regexp_extract_all(text, '\\]\\(([^)\\s]+)\\)', 1)), '#.*$', '') AS name FROM md WHERE NOT fence AND f % 2 = 0
  UNION ALL SELECT path, unnest(regexp_extract_all(text, '\\w+/\\w+\\.\\w+', 0)) FROM md WHERE NOT fence AND f % 2 = 0 AND NOT contains(text, '](')
), hit AS (
  SELECT r.path, coalesce(a.path, b.path) AS name FROM refs AS r
  LEFT JOIN files AS a ON a.path = CASE WHEN starts_with(name, '../../') THEN substr(name, 7) ELSE regexp_extract(r.path, '^.*/') || name END LEFT JOIN files AS b ON b.path = name
), e AS (
  SELECT 'artifact:' || path AS source, 'doc:' || path || '#' || line AS target, 'Contains' AS kind, 'Documentation' AS label FROM md WHERE NOT fence AND f % 2 = 0 AND regexp_matches(text, '^#+ ')
  UNION SELECT 'artifact:' || path, 'command:' || path || '#' || line, 'RunsCommand', 'Command' FROM md WHERE NOT fence AND f % 2 = 1 AND lang IN ('sh', 'bash', 'shell', 'console', 'zsh') AND trim(text) <> '' AND NOT starts_with(text, '#')
  UNION SELECT 'artifact:' || path, 'artifact:' || name, 'References', 'Artifact' FROM hit WHERE name IS NOT NULL
  UNION SELECT 'artifact:' || path, 'image:' || regexp_extract(text, '^(?i:from) (--\\S+ )?(\\S+)', 2), 'UsesImage', 'Container' FROM dk WHERE regexp_matches(text, '^(?i:from) ')
  UNION SELECT 'artifact:' || path, 'env:' || unnest(regexp_extract_all(text, '(\\w+)=', 1)), 'ReadsEnv', 'EnvVar' FROM dk WHERE regexp_matches(text, '^(ARG|ENV) ')
  UNION SELECT 'artifact:' || path, 'command:' || path || '#' || line, 'RunsCommand', 'Command' FROM dk WHERE regexp_matches(text, '^(RUN|CMD) ')
  UNION SELECT 'artifact:' || path, 'config:' || path || '#' || top || '.' || two, 'Contains', 'Config' FROM ym WHERE top IN ('services', 'jobs') AND regexp_matches(text, '^  \\w+:')
  UNION SELECT 'config:' || path || '#services.' || two, 'image:' || substr(text, 12), 'UsesImage', 'Container' FROM ym WHERE top = 'services' AND starts_with(text, '    image: ')
  UNION SELECT 'config:' || path || '#services.' || two, 'env:' || regexp_extract(text, '^      (?:- )?(\\w+)', 1), 'ReadsEnv', 'EnvVar' FROM ym WHERE top = 'services' AND four = 'environment' AND starts_with(text, '      ')
  UNION SELECT 'config:' || y.path || '#services.' || two, CASE WHEN o.path IS NULL THEN 'unresolved:' || substr(text, 9) ELSE 'config:' || y.path || '#services.' || substr(text, 9) END, 'References', CASE WHEN o.path IS NULL THEN 'Unresolved' ELSE 'Config' END
    FROM ym AS y LEFT JOIN (SELECT DISTINCT path, two AS name FROM ym WHERE top = 'services') AS o ON o.path = y.path AND o.name = substr(text, 9) WHERE top = 'services' AND four = 'depends_on' AND starts_with(text, '      - ')
  UNION SELECT 'config:' || path || '#jobs.' || two, 'command:' || path || '#jobs.' || two || '.steps[' || i || ']', 'RunsCommand', 'Command'
    FROM (SELECT *, row_number() OVER (PARTITION BY path, two ORDER BY line) - 1 AS i FROM ym WHERE top = 'jobs' AND starts_with(text, '      - ')) WHERE starts_with(text, '      - run: ')
  UNION SELECT 'config:' || path || '#jobs.' || two, 'env:' || trim(regexp_extract(text, '^          (\\w+)', 1)), 'ReadsEnv', 'EnvVar' FROM ym WHERE top = 'jobs' AND starts_with(text, '          ')
  UNION SELECT 'config:' || path || '#jobs.' || two, 'image:' || regexp_extract(text, '-t (\\S+)', 1), 'BuildsImage', 'Container' FROM ym WHERE top = 'jobs' AND contains(text, 'docker build')
  UNION SELECT 'config:' || path || '#jobs.' || two, 'image:' || regexp_extract(text, 'push (\\S+)', 1), 'PublishesImage', 'Container' FROM ym WHERE top = 'jobs' AND contains(text, 'docker push')
  UNION SELECT 'artifact:' || path, 'package:' || name, 'BelongsToPackage', 'Package' FROM own
  UNION SELECT coalesce('package:' || own.name, 'artifact:' || used.path), 'package:' || used.name, 'DependsOnPackage', 'Package' FROM used LEFT JOIN own ON own.path = used.path
  UNION SELECT 'artifact:' || path, CASE WHEN contains(name, '.') THEN 'config-key:' ELSE 'env:' END || name, CASE WHEN contains(name, '.') THEN 'BindsConfig' ELSE 'DefinesEnv' END, CASE WHEN contains(name, '.') THEN 'Config' ELSE 'EnvVar' END
    FROM (SELECT path, regexp_extract(text, '^(?:export )?([\\w.]+)[=:]', 1) AS name FROM l WHERE t = 7 AND regexp_matches(text, '^[a-zA-Z]'))
  UNION SELECT 'artifact:' || path, 'env:' || unnest(regexp_extract_all(text, '\\$\\{{?(\\w+)', 1)), 'ReadsEnv', 'EnvVar' FROM l WHERE t = 7
  UNION SELECT 'artifact:' || path, 'config:' || path || '#route.' || (row_number() OVER (PARTITION BY path ORDER BY line) - 1), 'Contains', 'Config' FROM l WHERE t = 8 AND regexp_matches(text, '^  rpc \\w+ \\(')
)
SELECT kind || '|' || source || '|' || target AS id, source, target, kind, label, CASE WHEN label = 'Unresolved' THEN 'Low' ELSE 'High' END AS confidence FROM e"""


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of STACKS with the analyzer that reads each."""
    rows = classify.classified(stack_files(spark, sf_dir))
    return rows.select("path", "content", classify.analyzer(F.col("path"), F.col("format"), F.col("analyzer")).alias("analyzer"))


@query(EDGE_SQL)
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of container files, documents, compose, workflows, manifests, protocols and settings, each file read once."""
    return facts.typed_edges(analyzed(spark, sf_dir))


@query(f"""WITH {LINES} SELECT path, line::INT AS line, lower(regexp_extract(text, '^\\w+', 0)) AS fact, trim(regexp_replace(text, '^\\w+', '')) AS name FROM dk WHERE regexp_matches(text, '^(EXPOSE|WORKDIR|COPY) ')
  UNION ALL SELECT path, line::INT, 'command', trim(regexp_replace(regexp_replace(text, '^\\w+', ''), '\\s+', ' ', 'g')) FROM dk WHERE regexp_matches(text, '^(RUN|CMD) ')
  UNION ALL SELECT path, line::INT, 'env', unnest(regexp_extract_all(text, '(\\w+)=', 1)) FROM dk WHERE regexp_matches(text, '^(ARG|ENV) ')
  UNION ALL SELECT path, line::INT, 'image', regexp_extract(text, '^(?i:from) (--\\S+ )?(\\S+)', 2) FROM dk WHERE regexp_matches(text, '^(?i:from) ')""")
def container_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, ports, settings and commands of container files as facts."""
    rows = facts.facts(analyzed(spark, sf_dir).where("analyzer = 'Dockerfile'"))
    return rows.select("path", "line", "fact", F.regexp_replace(F.variant_get("detail", "$.name", "string"), r"\s+", " ").alias("name"))


@query(f"WITH {LINES} SELECT path, package, scope, version FROM (SELECT path, regexp_extract(text, '^(\\w+) = ', 1) AS package, part AS scope, CASE WHEN contains(text, 'version') THEN regexp_extract(text, 'version = \"([^\"]*)\"', 1) ELSE regexp_extract(text, '= \"([^\"]*)\"', 1) END AS version FROM tm WHERE t = 4 AND part LIKE '%dependencies' AND regexp_matches(text, '^\\w+ = ') UNION ALL SELECT path, regexp_replace(lower(regexp_extract(text, '^  \"(\\w+)', 1)), '[_.]+', '-', 'g'), 'dependencies', regexp_extract(text, '^  \"\\w+(\\[\\w+\\])?([^\"]*)\"', 2) FROM tm WHERE t = 5 AND starts_with(text, '  \"') UNION ALL SELECT path, regexp_extract(text, '^    \"([^\"]+)\"', 1), obj, regexp_extract(text, ': \"([^\"]*)\"', 1) FROM tm WHERE t = 6 AND obj ILIKE '%dependencies' AND starts_with(text, '    \"'))")
def manifest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that Cargo, Python and npm manifests ask for, from one pass over the files."""
    from graphloom.operators.extract import MANIFESTS, manifest_packages

    rows = facts.facts(analyzed(spark, sf_dir).where(F.col("path").rlike(MANIFESTS))).where("fact = 'value'")
    get = lambda name: F.variant_get("detail", f"$.{name}", "string")
    return manifest_packages(rows.select("path", get("path").alias("config_path"), get("kind").alias("kind"), get("value").alias("value")))


@query(f"WITH {LINES} SELECT path, two AS service, max(CASE WHEN starts_with(text, '    image: ') THEN substr(text, 12) END) AS image, coalesce(string_agg(CASE WHEN four = 'depends_on' AND starts_with(text, '      - ') THEN substr(text, 9) END, ',' ORDER BY text), '') AS needs FROM ym WHERE t = 2 AND top = 'services' AND two IS NOT NULL GROUP BY path, two")
def stack_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of compose files that differ: lists and maps, with and without a second service, some that can't be read."""
    from graphloom.operators.extract import compose_services, structured

    found = compose_services(structured(analyzed(spark, sf_dir).where("analyzer = 'Compose'")))
    return found.select("path", "service", "image", F.array_join("depends_on", ",").alias("needs"))


@query(f"""WITH {LINES}, s AS (SELECT path, two AS job, text, line, row_number() OVER (PARTITION BY path, two ORDER BY line) - 1 AS step FROM ym WHERE t = 3 AND top = 'jobs' AND starts_with(text, '      - '))
SELECT path, job, step::INT AS step, nullif(regexp_extract(text, '- uses: (.*)$', 1), '') AS uses, nullif(regexp_extract(text, '- run: (.*)$', 1), '') AS run, nullif(regexp_extract(text, 'docker build.* -t (\\S+)', 1), '') AS image, contains(text, 'docker push') AS pushes FROM s""")
def stack_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of workflows of one or two jobs."""
    from graphloom.operators.extract import structured, workflow_steps

    return workflow_steps(structured(analyzed(spark, sf_dir).where("analyzer = 'Actions'")))
