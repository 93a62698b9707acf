"""Queries over places: positions in texts, labels of a layout, paths that ignore files leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import ignore, labels, positions
from graphloom.plans.registry import query
from graphloom.sources.files import STACKS, stack_files
from graphloom.sources.tables import table


@query(r"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Z]\w+') AS m, string_split_regex(text, '[A-Z]\w+') AS g FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, unnest(m) AS word, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM d),
p AS (SELECT doc_id, word, substr(text, 1, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - length(word)) AS ahead FROM w)
SELECT doc_id, word, strlen(ahead)::BIGINT AS "offset", (length(ahead) - length(replace(ahead, chr(10), '')) + 1)::BIGINT AS line,
  (length(replace(list_extract(string_split(ahead, chr(10)), -1), chr(13), '')) + 1)::BIGINT AS "column" FROM p""")
def capitalised_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offset, line and column of each word that begins with a capital."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = positions.match_offsets(docs, r"[A-Z]\w+")
    placed = positions.text_positions(docs, found)
    return found.join(placed, ["id", "offset"]).select(F.col("id").alias("doc_id"), F.col("match").alias("word"), "offset", "line", "column")


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, (p_partkey * 7919) % 1000 AS x, (p_partkey * 104729) % 997 AS z, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part),
walk(r, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, x BIGINT, z BIGINT)[] UNION ALL
  SELECT n.r, CASE WHEN len(list_filter(kept, lambda k: (k.x - n.x) * (k.x - n.x) + (k.z - n.z) * (k.z - n.z) < 3600)) > 0 THEN kept ELSE list_append(kept, {'id': n.id, 'x': n.x, 'z': n.z}) END
  FROM walk AS w JOIN n ON n.r = w.r + 1)
SELECT k.id FROM (SELECT unnest(kept) AS k FROM walk ORDER BY r DESC LIMIT (SELECT len(kept) FROM walk ORDER BY r DESC LIMIT 1))""")
def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on a plane that get a label: larger ones first, none nearer than 60 to another."""
    k = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_size").alias("priority"), ((k * 7919) % 1000).cast("double").alias("x"), ((k * 104729) % 997).cast("double").alias("z"))
    return labels.labelled(nodes, 60.0)


#: Ignore files over the folders of STACKS, in SQL that both run: path, content.
IGNORES = """
SELECT '.gitignore' AS path, '# of all' || chr(10) || '*.proto' || chr(10) || '/go/*7/' || chr(10) || '**/package.json' || chr(10) || 'py/r?3/' || chr(10) || '' || chr(10) || '!proto/b*.proto' AS content
UNION ALL SELECT regexp_replace(path, '[^/]*$', '') || '.gitignore', CASE k % 4 WHEN 0 THEN '*' || chr(10) || '!compose.yml' WHEN 1 THEN '/Dockerfile' ELSE 'no*.md' || chr(10) || '!package.json' || chr(10) || '*.toml' END FROM {files} WHERE k % 3 = 0
"""


@query(
    "WITH files AS (" + STACKS.replace("{part}", "part") + "), ig AS (" + IGNORES.replace("{files}", "files") + r"""),
l AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM ig),
r AS (SELECT folder, path, line, starts_with(t, '!') AS neg, ends_with(t, '/') AS dirs, regexp_replace(t, '^!|/$', '', 'g') AS p FROM l WHERE t <> '' AND NOT starts_with(t, '#')),
x AS (SELECT folder, path, line, neg, dirs, '^' || CASE WHEN contains(p, '/') AND NOT starts_with(p, '**/') THEN '' ELSE '(.*/)?' END || replace(replace(replace(regexp_replace(regexp_replace(p, '^\*\*/', ''), '^/', ''), '.', '\.'), '*', '[^/]*'), '?', '[^/]') || '$' AS rx FROM r),
e AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS entry FROM (SELECT DISTINCT path FROM files)),
m AS (SELECT e.path, e.entry, arg_max(neg, length(folder) * 1000 + line) AS neg FROM e JOIN x ON (folder = '' OR starts_with(entry, folder || '/')) AND (NOT dirs OR entry <> e.path)
  AND regexp_matches(CASE WHEN folder = '' THEN entry ELSE substr(entry, length(folder) + 2) END, rx) GROUP BY e.path, e.entry)
SELECT f.path, EXISTS (SELECT 1 FROM m WHERE m.path = f.path AND NOT neg) AS ignored FROM (SELECT DISTINCT path FROM files) AS f"""
)
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files the ignore files of the root and of many folders leave out."""
    rows = stack_files(spark, sf_dir)
    return ignore.ignored(rows, ignore.ignore_rules(spark.sql(IGNORES, files=rows)))
