"""Queries over rules that go in an order: budgets, owners, configs that extend each other; and what documents mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import budget, extract, mentions, owners, resolve
from graphloom.plans.registry import query
from graphloom.sources.tables import table


@query("""WITH RECURSIVE r AS (SELECT o_custkey % 12 AS module, o_orderkey AS k, floor(o_totalprice / 3.5)::BIGINT AS tokens, row_number() OVER (PARTITION BY o_custkey % 12 ORDER BY o_orderkey) AS i FROM orders),
w AS (SELECT module, k, tokens, i, 0::BIGINT AS part, tokens AS used FROM r WHERE i = 1 UNION ALL
  SELECT r.module, r.k, r.tokens, r.i, CASE WHEN used + r.tokens > 300000 THEN part + 1 ELSE part END, CASE WHEN used + r.tokens > 300000 THEN r.tokens ELSE used + r.tokens END FROM w JOIN r ON r.module = w.module AND r.i = w.i + 1)
SELECT module, k, tokens, part FROM w""")
def budget_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a module in parts of 300,000 tokens, one after the other; most of them are in a few modules."""
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_custkey") % 12).alias("module"), F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") / 3.5).cast("long").alias("tokens"))
    return budget.cut_by_budget(rows, "module", ["k"], "tokens", 300_000)


#: Relations over lineitem: a part is in two modules of suppliers at times, and orders contain parts; place is their order.
GIFTS = """g AS (SELECT l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_orderkey % 7 < 2 THEN 'part:' || l_partkey ELSE 'order:' || l_orderkey END AS source,
  CASE WHEN l_orderkey % 7 < 2 THEN 'module:' || (l_suppkey % 9) ELSE 'part:' || l_partkey END AS target, CASE WHEN l_orderkey % 7 < 2 THEN 'BelongsToModule' ELSE 'Contains' END AS kind FROM lineitem
  UNION ALL SELECT 100000000000 + o_orderkey, 'part:' || (o_custkey * 3), 'order:' || o_orderkey, 'Contains' FROM orders WHERE o_orderkey % 3 = 0)"""


@query(f"""WITH RECURSIVE {GIFTS.replace("g AS", "e AS", 1)}, g AS (SELECT row_number() OVER (ORDER BY place, kind, source, target) AS place, source, target, kind FROM (SELECT DISTINCT * FROM e)), m AS (SELECT DISTINCT target AS id FROM g WHERE kind = 'BelongsToModule' AND target <> 'module:8'),
seen(id) AS (SELECT id FROM m UNION SELECT source FROM g WHERE kind = 'BelongsToModule' AND target <> 'module:8' UNION SELECT target FROM g JOIN seen ON g.source = seen.id WHERE kind = 'Contains'),
r AS (SELECT place, source AS node, target AS owner, NULL::VARCHAR AS of FROM g WHERE kind = 'BelongsToModule' AND target <> 'module:8' UNION ALL SELECT place, target, NULL::VARCHAR, source FROM g WHERE kind = 'Contains' AND source IN (SELECT id FROM seen)),
l AS (SELECT node, max(place) AS last FROM r GROUP BY node),
n AS (SELECT r.place, r.node, r.owner, coalesce(b.place, l.last) AS prev FROM r LEFT JOIN l ON l.node = r.of ASOF LEFT JOIN r AS b ON b.node = r.of AND b.place < r.place),
walk(id, spot, hops) AS (SELECT node, last, 0 FROM l UNION ALL SELECT id, prev, hops + 1 FROM walk JOIN n ON n.place = walk.spot WHERE n.owner IS NULL AND prev IS NOT NULL AND hops < 2000)
SELECT id, owner FROM (SELECT id, n.owner FROM walk JOIN n ON n.place = walk.spot WHERE n.owner IS NOT NULL UNION ALL SELECT id, id FROM m)""")
def pushed_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that own parts and orders, where several claim a part and the last relation wins."""
    lines, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    own = F.col("l_orderkey") % 7 < 2
    part = name("part:", F.col("l_partkey"))
    rows = lines.select(
        F.when(own, part).otherwise(name("order:", F.col("l_orderkey"))).alias("source"), F.when(own, name("module:", F.col("l_suppkey") % 9)).otherwise(part).alias("target"),
        F.when(own, "BelongsToModule").otherwise("Contains").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"),
    )
    back = o.where("o_orderkey % 3 = 0").select(name("part:", F.col("o_custkey") * 3).alias("source"), name("order:", F.col("o_orderkey")).alias("target"), F.lit("Contains").alias("kind"), (F.lit(100_000_000_000) + F.col("o_orderkey")).alias("place"))
    modules = rows.where("kind = 'BelongsToModule' AND target <> 'module:8'").select(F.col("target").alias("id")).distinct()
    return owners.pushed_owners(modules, rows.unionByName(back))


#: Configs over the part table, in chains of up to eight with circles: k, path, extends; and their patterns.
CONFIGS = "c AS (SELECT p_partkey AS k, 'p' || (p_partkey // 8) || '/c' || (p_partkey % 8) || '.json' AS path, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 11 = 1 THEN '@pkg/base' ELSE './c' || ((p_partkey + 1 + p_size % 2) % 8) || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.json' END END AS extends, p_size FROM part), a AS (SELECT path, '@' || (p_size % 4) || '/*' AS pattern, 0 AS \"at\", 'src' || k AS target FROM c WHERE p_size % 2 = 0)"


@query(f"""WITH RECURSIVE {CONFIGS}, u AS (SELECT path, regexp_replace(path, '[^/]*$', '') || replace(substr(extends, 3), '.json', '') || '.json' AS up FROM c WHERE starts_with(extends, './')),
walk(path, spot, depth, seen) AS (SELECT path, path, 0::BIGINT, [path] FROM c UNION ALL SELECT w.path, u.up, depth + 1, list_append(seen, u.up) FROM walk AS w JOIN u ON u.path = w.spot JOIN c ON c.path = u.up WHERE NOT list_contains(seen, u.up))
SELECT w.path, a.pattern, a."at", a.target, w.spot AS origin, depth FROM walk AS w JOIN a ON a.path = w.spot QUALIFY row_number() OVER (PARTITION BY w.path, a.pattern ORDER BY depth) = 1""")
def extended_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that configs have through what they extend."""
    p, k, n = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    number = lambda c: c.cast("string")
    path = F.concat(F.lit("p"), number(F.floor(k / 8)), F.lit("/c"), number(k % 8), F.lit(".json"))
    name = F.concat(F.lit("./c"), number((k + 1 + n % 2) % 8), F.when(n % 3 == 0, "").otherwise(".json"))
    extends = F.when(n % 5 == 0, F.lit(None)).when(n % 11 == 1, "@pkg/base").otherwise(name)
    configs = p.select(path.alias("path"), extends.alias("extends"))
    aliases = p.where("p_size % 2 = 0").select(path.alias("path"), F.concat(F.lit("@"), number(n % 4), F.lit("/*")).alias("pattern"), F.lit(0).alias("at"), F.concat(F.lit("src"), number(k)).alias("target"))
    return resolve.extended_aliases(configs, aliases)


#: Documents over the part table that mention images, services and commands, in SQL that both run: k, path, content.
MENTIONS = """SELECT k, 'docs/m' || k || '.md' AS path, 'Uses `ghcr.io/' || noun || '/app:' || (k % 5) || '` and `http://x/y:1` here.' || chr(10) || CASE WHEN k % 2 = 0 THEN 'The `' || noun || '` service runs.' ELSE 'Services: `' || adj || '`, `some words` and far away, without the word, `' || noun || '`.' END || chr(10)
  || '```sh' || chr(10) || CASE k % 3 WHEN 0 THEN 'just ' || noun WHEN 1 THEN 'make ' || adj ELSE 'yarn run ' || noun END || chr(10) || 'npm install' || chr(10) || '```' || chr(10) || '`open ' AS content
FROM (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM {part}) AS p"""
RUNNERS = """SELECT 'a' || k || CASE k % 3 WHEN 0 THEN '/justfile' WHEN 1 THEN '/Makefile' ELSE '/package.json' END AS path, CASE k % 3 WHEN 0 THEN 'set shell := x' || chr(10) || noun || ':' || chr(10) || '  other: x' WHEN 1 THEN adj || ' : dep' || chr(10) || '# no:' ELSE '{"scripts": {"' || noun || '": "x"}}' END AS content
FROM (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM {part}) AS p WHERE k % 29 < 3 AND CASE WHEN k % 3 = 1 THEN adj ELSE noun END < 'm'"""


def _mentions(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("{{part}}", "{part}"), part=table(spark, sf_dir, "part"))


@query(f"""WITH d AS ({MENTIONS.replace("{part}", "part")}), i AS (SELECT DISTINCT 'ghcr.io/' || split_part(p_name, ' ', 2) || '/app:' || (p_partkey % 3) AS reference FROM part WHERE p_partkey % 17 = 3), s AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part WHERE p_partkey % 13 = 1),
t AS (SELECT path, string_split(content, '`') AS p, unnest(range(2, len(string_split(content, '`')), 2)) AS j FROM d),
w AS (SELECT path, p[j] AS token, contains(lower(right(array_to_string(p[1:j - 1], '`'), 15) || '`' || p[j] || '`' || left(array_to_string(p[j + 1:], '`'), 14)), 'service') AS near FROM t WHERE p[j] <> '' AND NOT contains(p[j], chr(10)))
SELECT path, CASE WHEN a.actual IS NULL THEN 'StaleImage' ELSE 'ContradictsCurrentFact' END AS rule, token AS subject, a.actual FROM w LEFT JOIN (SELECT regexp_replace(reference, ':[^:]*$', '') AS image, min(reference) AS actual FROM i GROUP BY 1) AS a ON a.image = regexp_replace(token, ':[^:]*$', '')
  WHERE contains(token, '/') AND contains(token, ':') AND NOT contains(token, ' ') AND NOT starts_with(token, 'http') AND token NOT IN (SELECT reference FROM i)
UNION ALL SELECT path, 'StaleService', token, NULL FROM w WHERE near AND regexp_matches(token, '^[A-Za-z0-9_-]+$') AND token NOT IN (SELECT name FROM s)""")
def stale_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with another tag or none, and services, that documents name and the repository does not have."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    images = part.where("p_partkey % 17 = 3").select(F.concat(F.lit("ghcr.io/"), noun, F.lit("/app:"), (k % 3).cast("string")).alias("reference"))
    return mentions.stale_mentions(_mentions(spark, sf_dir, MENTIONS), images, part.where("p_partkey % 13 = 1").select(noun.alias("name")))


@query(f"""WITH d AS ({MENTIONS.replace("{part}", "part")}), r AS ({RUNNERS.replace("{part}", "part")}),
l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM d),
rl AS (SELECT path, unnest(string_split(content, chr(10))) AS text FROM r),
t AS (SELECT 'just' AS program, trim(split_part(text, ':', 1)) AS target FROM rl WHERE ends_with(path, 'justfile') AND regexp_matches(text, '^[a-z]+ *:') UNION SELECT 'make', trim(split_part(text, ':', 1)) FROM rl WHERE ends_with(path, 'Makefile') AND regexp_matches(text, '^[a-z]+ *:')
  UNION SELECT 'npm', unnest(json_keys(content, '$.scripts')) FROM r WHERE ends_with(path, 'package.json')),
c AS (SELECT path, line::BIGINT AS line, text AS command, CASE WHEN starts_with(text, 'yarn') THEN 'npm' ELSE split_part(text, ' ', 1) END AS program, regexp_extract(text, '\\S+$') AS target FROM l WHERE regexp_matches(text, '^(just|make|yarn run) '))
SELECT path, line, command, program, target FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.program = c.program AND t.target = c.target)""")
def stale_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes, goals and scripts that documents tell to run and no file has."""
    return mentions.stale_commands(extract.commands(_mentions(spark, sf_dir, MENTIONS)), mentions.runner_targets(_mentions(spark, sf_dir, RUNNERS)))
