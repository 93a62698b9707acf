"""Queries over claims, tags, settings, pages and the lab's comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import extensions
from graphloom.operators import extract, findings, incremental, planning, quality
from graphloom.plans.file_queries import CLASSES, F_, L_, LAYER_SQL, classified
from graphloom.plans.graph_queries import COMMERCE
from graphloom.plans.registry import query
from graphloom.plans.text_queries import LINES
from graphloom.sources.files import files
from graphloom.sources.tables import commerce_graph, document_lines, table


@query(f"WITH {CLASSES}, n AS (SELECT 'artifact:' || path AS id, path, CASE WHEN category IN ('x') THEN '' END AS y, {LAYER_SQL} AS layer FROM gated) SELECT id AS entity_id, 'kind' AS namespace, 'artifact' AS value FROM n UNION SELECT id, 'role', 'test' FROM n WHERE contains(id, 'test') UNION SELECT id, 'layer', lower(layer) FROM n WHERE layer IS NOT NULL")
def derived_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of files: kind, test role, layer."""
    from graphloom.functions import paths

    rows = files(spark, sf_dir)
    layers = rows.select("path", F.nullif(paths.layer(F.col("path")), F.lit("Unknown")).alias("layer")).where("layer IS NOT NULL")
    return quality.derived_tags(rows.select(F.concat(F.lit("artifact:"), "path").alias("id"), "path"), layers)


@query(f"WITH {LINES}, c AS (SELECT doc_id, line, text FROM lines WHERE regexp_matches(text, '^[^a-z]*[a-z]') AND line = 1) SELECT doc_id, line, sha256('First:' || lower(trim(regexp_replace(text, '[ \\t\\r\\f\\v]+', ' ', 'g')))) AS fingerprint FROM c")
def claim_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of first lines as claims."""
    rows = document_lines(spark, sf_dir).where(F.col("text").rlike("^[^a-z]*[a-z]") & (F.col("line") == 1))
    return quality.claim_fingerprints(rows.select("doc_id", "line", F.lit("First").alias("claim"), "text")).drop("claim")


DIAGRAMS = f"{F_}, d AS (SELECT k, 'p' || k || '.md' AS path, CASE k % 4 WHEN 0 THEN 'graph TD' || chr(10) || 'A[x] --> B(y)' WHEN 1 THEN '' WHEN 2 THEN 'grph TD' || chr(10) || 'A' ELSE 'flowchart LR' || chr(10) || 'A[x --> B' END AS body FROM files)"


def diagram_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    body = F.when(k % 4 == 0, "graph TD\nA[x] --> B(y)").when(k % 4 == 1, "").when(k % 4 == 2, "grph TD\nA").otherwise("flowchart LR\nA[x --> B")
    content = F.concat(F.lit("# Title\n```mermaid\n"), body, F.lit("\n```\nSource: bare words\n## Open questions\n[next](p"), (k + 1).cast("string"), F.lit(".md)\n[gone](q.md)"))
    return files(spark, sf_dir).select("k", F.concat(F.lit("p"), k.cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


@query(f"WITH {DIAGRAMS} SELECT path, 2 AS line, CASE k % 4 WHEN 1 THEN 'empty' WHEN 2 THEN 'unknown_kind' ELSE 'unbalanced' END AS finding FROM d WHERE k % 4 <> 0")
def diagram_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.diagram_findings(diagram_pages(spark, sf_dir))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'n_' || p_partkey || '_' || replace(p_name, ' ', '_') ELSE regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g') END AS safe FROM part")
def safe_diagram_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), quality.safe_diagram_id(raw).alias("safe"))


@query(f"WITH {DIAGRAMS}, e AS (SELECT path AS page, 's' || (k % 10) AS source, 'h' || (k % 3) AS digest FROM d WHERE k % 5 <> 2), s AS (SELECT 's' || i AS source, 'h' || (i % 3) AS digest FROM range(9) t(i)) SELECT path, 'PageWithoutEvidence' AS finding, '' AS detail FROM d WHERE k % 5 = 2 UNION ALL SELECT path, 'UnresolvedQuestions', '' FROM d UNION ALL SELECT path, 'EmptyMermaid', '2' FROM d WHERE k % 4 = 1 UNION ALL SELECT path, 'WeakModuleCoverage', (k % 4) || '/5' FROM d WHERE k % 4 < 2.5 UNION ALL SELECT path, 'MissingSourceLink', NULL FROM d WHERE false UNION ALL SELECT path, 'BrokenGeneratedDocLink', 'q.md' FROM d UNION ALL SELECT path, 'BrokenGeneratedDocLink', 'p' || (k + 1) || '.md' FROM d WHERE k + 1 NOT IN (SELECT k FROM d) UNION ALL SELECT page, 'InvalidSourceRef', source FROM e WHERE source NOT IN (SELECT source FROM s) UNION ALL SELECT page, 'StaleEvidence', e.source FROM e JOIN s ON s.source = e.source WHERE s.digest <> e.digest")
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lint of generated pages."""
    pages = diagram_pages(spark, sf_dir)
    k = F.col("k")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    evidence = pages.where("k % 5 <> 2").select(F.col("path").alias("page"), text("s", k % 10).alias("source"), text("h", k % 3).alias("digest"))
    sources = spark.range(9).select(text("s", F.col("id")).alias("source"), text("h", F.col("id") % 3).alias("digest"))
    modules = pages.select(F.col("path").alias("page"), F.lit(5).alias("members"), (k % 4).alias("cited"))
    return quality.page_findings(pages.drop("k"), evidence, sources, modules)


@query("SELECT o_custkey AS c, count(*) AS n, CASE WHEN count(*) <= 1 THEN 30 WHEN count(*) < 5 THEN 60 ELSE 85 END AS confidence FROM orders GROUP BY 1")
def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("confidence", quality.confidence_of(F.col("n")))


@query(f"WITH {COMMERCE}, p AS (SELECT id, name, split_part(id, ':', 1) AS prefix, row_number() OVER (PARTITION BY split_part(id, ':', 1) ORDER BY id) AS k FROM nodes) SELECT prefix, count(*) AS n, string_agg(name, ',' ORDER BY k) FILTER (k <= 3) AS examples FROM p GROUP BY prefix")
def id_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.id_sections(commerce_graph(spark, sf_dir).nodes).withColumn("examples", F.array_join("examples", ","))


SETTINGS = """e AS (SELECT DISTINCT upper(split_part(p_name, ' ', 2)) || '_' || upper(split_part(p_name, ' ', 1)) AS env, 'a' AS path FROM part),
c AS (SELECT DISTINCT split_part(p_name, ' ', 2) || '.' || lower(p_type) AS conf, 'a' AS path FROM part),
ew AS (SELECT env, list_distinct(string_split(lower(env), '_')) AS w, replace(lower(env), '_', '') AS j FROM e), cw AS (SELECT conf, list_distinct(string_split(conf, '.')) AS w, replace(conf, '.', '') AS j FROM c),
et AS (SELECT *, list_distinct(list_transform(range(1, length(j) - 1), lambda i: substr(j, i, 3))) AS t FROM ew), ct AS (SELECT *, list_distinct(list_transform(range(1, length(j) - 1), lambda i: substr(j, i, 3))) AS t FROM cw),
m AS (SELECT env, conf, least(300, 100 * len(list_intersect(a.w, b.w))) + floor(250 * len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))) + CASE WHEN a.j = b.j THEN 150 WHEN contains(a.j, b.j) OR contains(b.j, a.j) THEN 100 WHEN a.w[1] = b.w[1] THEN 50 ELSE 0 END + 100 AS score FROM et a JOIN ct b ON len(list_intersect(a.w, b.w)) > 0 OR len(list_intersect(a.t, b.t)) > 0)"""


@query(f"WITH {SETTINGS.replace('list_distinct(string_split(lower(env)', 'list_reverse(list_reverse(string_split(lower(env)').replace(chr(39) + '_' + chr(39) + ')) AS w, replace(lower', chr(39) + '_' + chr(39) + '))) AS w, replace(lower').replace('list_distinct(string_split(conf, ' + chr(39) + '.' + chr(39) + '))', 'string_split(conf, ' + chr(39) + '.' + chr(39) + ')')}, r AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY score DESC, conf) AS rank FROM m) SELECT env, conf, score::BIGINT AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def setting_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best settings for each variable by words, trigrams and place."""
    part = table(spark, sf_dir, "part")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    names = part.select(F.concat_ws("_", F.upper(word(2)), F.upper(word(1))).alias("env"), F.lit("a").alias("path")).distinct()
    keys = part.select(F.concat_ws(".", word(2), F.lower("p_type")).alias("conf"), F.lit("a").alias("path")).distinct()
    return quality.setting_candidates(names, keys)


@query("WITH n AS (SELECT DISTINCT upper(split_part(p_name, ' ', 2)) || '_URL' AS env FROM part UNION SELECT 'LONELY_URL'), u AS (SELECT upper(split_part(p_name, ' ', 2)) || '_URL' AS env, p_brand AS user FROM part), d AS (SELECT DISTINCT split_part(p_name, ' ', 2) || '.url' AS conf FROM part WHERE p_partkey % 2 = 0) SELECT n.env, coalesce((SELECT string_agg(DISTINCT user, ',' ORDER BY user) FROM u WHERE u.env = n.env), '') AS users, CASE WHEN lower(replace(n.env, '_', '.')) IN (SELECT conf FROM d) THEN 'app' ELSE '' END AS definitions, CASE WHEN lower(replace(n.env, '_', '.')) IN (SELECT conf FROM d) THEN 'linked' WHEN n.env = 'LONELY_URL' THEN 'unused' ELSE 'undefined' END AS reason FROM n")
def setting_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    uses = part.select(F.concat(F.upper(noun), F.lit("_URL")).alias("env"), F.col("p_brand").alias("user"))
    names = uses.select("env").distinct().unionByName(spark.range(1).select(F.lit("LONELY_URL").alias("env")))
    keys = part.where("p_partkey % 2 = 0").select(F.concat(noun, F.lit(".url")).alias("conf"), F.lit("app").alias("place")).distinct()
    return quality.setting_explanations(names, uses, keys).withColumns({"users": F.array_join("users", ","), "definitions": F.array_join("definitions", ",")})


@query("WITH a AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'parse' ELSE 'build' END AS stage, o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 10 <> 4), b AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'parse' ELSE 'build' END AS stage, o_orderkey AS key, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 8 = 2 THEN 'new' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 10 <> 5), j AS (SELECT coalesce(a.stage, b.stage) AS stage, a.key AS x, b.key AS y, a.value AS v, b.value AS w FROM a FULL JOIN b ON a.key = b.key) SELECT stage, count(*) FILTER (x IS NULL) AS added, count(*) FILTER (y IS NULL) AS removed, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND v IS DISTINCT FROM w) AS changed, stage = 'parse' AS first FROM j GROUP BY stage HAVING count(*) FILTER (x IS NULL OR y IS NULL OR v IS DISTINCT FROM w) > 0")
def baseline_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that differ from a baseline, and the first of them."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    stage = F.when(k % 3 == 0, "scan").when(k % 3 == 1, "parse").otherwise("build")
    row = lambda df, v: df.select(stage.alias("stage"), k.alias("key"), v.alias("value"))
    old = row(o.where("o_orderkey % 3 = 0 OR o_orderkey % 10 <> 4"), F.col("o_orderstatus"))
    new = row(o.where("o_orderkey % 3 = 0 OR o_orderkey % 10 <> 5"), F.when((k % 3 != 0) & (k % 8 == 2), "new").otherwise(F.col("o_orderstatus")))
    return quality.baseline_difference(old, new, ["scan", "parse", "build"])


@query("WITH o AS (SELECT 'c' || c_nationkey AS \"case\", c_mktsegment AS signature, count(*) AS n FROM customer GROUP BY ALL), k AS (SELECT \"case\", signature, CASE WHEN \"case\" = 'c3' THEN n + 1 ELSE n END AS n, CASE WHEN \"case\" = 'c4' THEN '2020-01-01' ELSE '2030-01-01' END AS expires FROM o WHERE \"case\" <> 'c5') SELECT DISTINCT \"case\", CASE \"case\" WHEN 'c5' THEN 'unknown' WHEN 'c4' THEN 'expired' WHEN 'c3' THEN 'changed' ELSE 'accepted' END AS state FROM o")
def known_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("case"), F.col("c_mktsegment").alias("signature"))
    counts = seen.groupBy("case", "signature").agg(F.count(F.lit(1)).alias("n")).where("`case` <> 'c5'")
    known = counts.select("case", "signature", F.when(F.col("case") == "c3", F.col("n") + 1).otherwise(F.col("n")).alias("n"), F.when(F.col("case") == "c4", "2020-01-01").otherwise("2030-01-01").alias("expires"))
    return quality.known_failures(seen, known, "2025-01-01")


@query("WITH r AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_name) AS rank FROM nation) SELECT rank::INTEGER AS position, 'Why do so many things depend on ' || name || '?' AS question FROM r WHERE rank <= 3 UNION ALL SELECT (rank + 3)::INTEGER, 'What would break without ' || name || '?' FROM r WHERE rank <= 3 UNION ALL SELECT (rank + 6)::INTEGER, 'What should ' || name || ' resolve to?' FROM r WHERE rank <= 3 UNION ALL SELECT 10, 'Which parts have no evidence at all?'")
def audit_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ranked = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.row_number().over(Window.orderBy("n_name")).alias("rank"))
    return quality.audit_questions(ranked, ranked, ranked)


@query(f"""WITH {COMMERCE}, loose AS (SELECT 1 FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)), l AS (SELECT id, label FROM nodes)
SELECT 'r1' AS rule, EXISTS (SELECT 1 FROM nodes WHERE id = 'nation:3') AS holds UNION ALL SELECT 'r2', NOT EXISTS (SELECT 1 FROM nodes WHERE id = 'nation:333')
UNION ALL SELECT 'r3', EXISTS (SELECT 1 FROM edges WHERE source = 'customer:1' AND kind = 'BelongsTo') UNION ALL SELECT 'r4', NOT EXISTS (SELECT 1 FROM edges WHERE source = 'nation:3' AND target = 'nation:4')
UNION ALL SELECT 'r5', (SELECT count(*) FILTER (source = 'nation:3') + count(*) FILTER (target = 'nation:3') FROM edges) >= 2 UNION ALL SELECT 'r6', NOT EXISTS (SELECT 1 FROM loose)
UNION ALL SELECT 'r7', (SELECT label FROM l WHERE id = 'nation:3') = (SELECT label FROM l WHERE id = 'nation:4') UNION ALL SELECT 'r8', (SELECT label FROM l WHERE id = 'nation:3') = (SELECT label FROM l WHERE id = 'region:1')
UNION ALL SELECT 'r9', EXISTS (SELECT 1 FROM nodes WHERE id = 'no:such')""")
def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a graph is expected to hold."""
    rules = [("r1", "NodeExists", "nation:3", None), ("r2", "NodeAbsent", "nation:333", None), ("r3", "EdgeExists", "customer:1", None), ("r4", "EdgeAbsent", "nation:3", "nation:4"), ("r5", "MinimumDegree", "nation:3", "2"), ("r6", "NoDangling", None, None), ("r7", "SameLabel", "nation:3", "nation:4"), ("r8", "SameLabel", "nation:3", "region:1"), ("r9", "NodeExists", "no:such", None)]
    g = commerce_graph(spark, sf_dir)
    home = g.edges.where("source = 'customer:1' AND kind = 'BelongsTo'").select("target")
    rows = spark.createDataFrame(rules, "rule string, kind string, a string, b string").crossJoin(F.broadcast(home))
    return quality.expectations(rows.select("rule", "kind", "a", F.when(F.col("rule") == "r3", F.col("target")).otherwise(F.col("b")).alias("b")), g.nodes, g.edges)


@query("WITH l AS (SELECT c_custkey AS id, c_nationkey AS a, CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE c_nationkey % 5 END AS b FROM customer), p AS (SELECT (x.a = y.a) = (x.b = y.b) AS same FROM l x JOIN l y ON x.id < y.id) SELECT count(*)::DOUBLE AS pairs, count(*) FILTER (same)::DOUBLE AS agreeing, round(count(*) FILTER (same) / count(*), 9) AS accuracy FROM p")
def pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groupings of customers by the pairs they agree on."""
    c = F.col("c_custkey")
    labels = table(spark, sf_dir, "customer").select(c.alias("id"), F.col("c_nationkey").alias("a"), F.when(c % 10 == 0, -1).otherwise(F.col("c_nationkey") % 5).alias("b"))
    return quality.pair_accuracy(labels).withColumn("accuracy", F.round("accuracy", 9))


RUNS = "runs AS (SELECT c_custkey AS run, c_custkey % 4 AS hits, c_custkey % 3 AS misses, c_custkey * 7 AS chars FROM customer)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("run"), (c % 4).alias("hits"), (c % 3).alias("misses"), (c * 7).alias("chars"))


@query(f"WITH {RUNS} SELECT run, 'chars' AS measure, chars::DOUBLE AS value, 700.0::DOUBLE AS budget FROM runs WHERE chars > 700 UNION ALL SELECT run, 'misses', misses::DOUBLE, 1.0::DOUBLE FROM runs WHERE misses > 1")
def over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.over_budget(runs(spark, sf_dir), {"chars": 700, "misses": 1, "hits": 9})


@query(f"WITH {RUNS} SELECT run, round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 1 END, 6)::DOUBLE AS hit_rate, ceil(chars / 4)::BIGINT AS tokens FROM runs")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run_metrics(runs(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 6))


@query("WITH a AS (SELECT c_nationkey AS n, c_mktsegment AS s FROM customer), b AS (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 20 <> 1) SELECT n, s, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)")
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractions, row by row with their counts."""
    c = table(spark, sf_dir, "customer")
    row = lambda df: df.select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"))
    return quality.differences(row(c), row(c.where("c_custkey % 20 <> 1")))


@query(f"WITH {L_} SELECT DISTINCT 'DeclaresRequirement|artifact:' || path || '|package:' || p AS id, 'artifact:' || path AS source, 'package:' || p AS target, 'DeclaresRequirement' AS kind FROM (SELECT path, regexp_replace(lower(regexp_extract(text, '^([A-Za-z0-9_]+)', 1)), '_+', '-', 'g') AS p FROM flines WHERE ends_with(path, '/requirements.txt') AND regexp_matches(text, '^[A-Za-z]'))")
def requirement_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from facts, through the analyzer that the files are dispatched to."""
    from graphloom.functions import classify

    rows = classified(spark, sf_dir)
    rows = rows.where("path LIKE '%/requirements.txt'").select("path", "content", classify.analyzer(F.col("path"), F.col("format"), F.lit("Specialized")).alias("kind"))
    facts = extensions.analyzed(rows, "Requirements")["packages"]
    return extensions.fact_edges(facts.withColumn("target", F.concat(F.lit("package:"), "package")), "DeclaresRequirement", "target")


@query("WITH r AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'Buys' ELSE 'Other' END AS kind FROM orders), c AS (SELECT r.key, r.kind, o_custkey FROM r JOIN orders ON o_orderkey = r.key) SELECT key, CASE WHEN kind = 'Buys' THEN 'customer:' || o_custkey ELSE 'nation:' || (o_custkey % 25) END AS target, CASE WHEN kind = 'Buys' THEN 'customer' ELSE 'nation' END AS strategy FROM c")
def resolved_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolvers in order; what a kind may not point to is passed over."""
    o = table(spark, sf_dir, "orders")

    class By:
        def __init__(self, name, target):
            self.name, self.target = name, target

        def resolve(self, references: DataFrame) -> DataFrame:
            return references.join(o.select(F.col("o_orderkey").alias("key"), self.target.alias("target")), "key")

    references = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, "Buys").otherwise("Other").alias("kind"))
    nation = By("nation", F.concat(F.lit("nation:"), (F.col("o_custkey") % 25).cast("string")))
    customer = By("customer", F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")))
    accepted = spark.createDataFrame([("Buys", "Customer")], "kind string, label string")
    labels = commerce_graph(spark, sf_dir).nodes.select(F.col("id").alias("target"), "label")
    return extensions.resolve_with(references, [nation, customer], accepted, labels)


@query(f"WITH {F_}, b AS (SELECT string_split(path, '/')[1] AS module, count(*) AS members FROM files GROUP BY 1) SELECT module, CASE WHEN members < 9 THEN 'group:' || CASE WHEN module LIKE 's%' THEN 'code' ELSE 'rest' END ELSE module END AS target FROM b")
def merged_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small modules go together with those of their kind."""
    n = files(spark, sf_dir).groupBy(F.element_at(F.split("path", "/"), 1).alias("module")).agg(F.count(F.lit(1)).alias("members"))
    return planning.merged_by_kind(n.withColumn("kind", F.when(F.col("module").like("s%"), "code").otherwise("rest")), 9)


@query("WITH n AS (SELECT c_nationkey AS owner, string_agg(c_custkey || ':' || c_mktsegment, ',' ORDER BY c_custkey) AS d FROM customer GROUP BY 1), o AS (SELECT c_nationkey AS owner, string_agg(c_custkey || ':' || c_mktsegment, ',' ORDER BY c_custkey) AS d FROM customer WHERE c_custkey % 40 <> 3 GROUP BY 1) SELECT coalesce(n.owner, o.owner) AS owner, CASE WHEN o.owner IS NULL OR n.d <> o.d THEN 'rebuilt' WHEN n.owner IS NULL THEN 'deleted' ELSE 'reused' END AS action FROM n FULL JOIN o ON n.owner = o.owner")
def fragment_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments by the digest of their rows: reused, rebuilt, deleted."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("id"), "c_mktsegment")
    return incremental.fragment_plan(c.where("id % 40 <> 3"), c, "owner")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'logic_version' WHEN c_custkey % 6 = 1 THEN 'input' WHEN c_custkey % 6 = 2 THEN 'dependencies' WHEN c_custkey % 6 = 3 THEN 'schema_version' WHEN c_custkey % 6 = 4 THEN 'new' ELSE 'same' END AS reason FROM customer")
def fingerprint_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing that makes a stored result useless."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.lit(1).alias("logic_version"), F.lit("a").alias("input"), F.lit("d").alias("dependencies"), F.lit(2).alias("schema_version"))
    stored = rows.where("id % 6 <> 4").select("id", F.when(F.col("id") % 6 == 0, 0).otherwise(1).alias("logic_version"), F.when(F.col("id") % 6 <= 1, "b").otherwise("a").alias("input"), F.when(F.col("id") % 6 <= 2, "e").otherwise("d").alias("dependencies"), F.when(F.col("id") % 6 <= 3, 1).otherwise(2).alias("schema_version"))
    return incremental.fingerprint_reasons(stored, rows, "id", ["logic_version", "input", "dependencies", "schema_version"])


@query("WITH p AS (SELECT p_partkey AS k, p_name || ' ' || p_brand || ' ' || p_type || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_partkey END AS name FROM part), u AS (SELECT name, min(k) AS k FROM p GROUP BY name HAVING count(DISTINCT k) = 1) SELECT name, k FROM u")
def unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by names that only one of them has."""
    from graphloom.operators import relational

    k = F.col("p_partkey")
    names = table(spark, sf_dir, "part").select(k.alias("k"), F.concat_ws(" ", "p_name", "p_brand", "p_type", F.when(k % 3 != 0, k.cast("string"))).alias("name"))
    return relational.unique_match(names.select("name").distinct(), names, "name", "k").select("name", "k")


@query(f"WITH {COMMERCE}, extra AS (SELECT 'bad|' || o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'ghost:1' ELSE 'order:' || o_orderkey END AS source, CASE o_orderkey % 3 WHEN 1 THEN 'ghost:2' WHEN 2 THEN 'part:1' ELSE 'customer:1' END AS target FROM orders WHERE o_orderkey % 100 < 6) SELECT id AS edge_id, 'dangling_source' AS issue FROM extra WHERE source = 'ghost:1' UNION ALL SELECT id, 'dangling_target' FROM extra WHERE target = 'ghost:2' UNION ALL SELECT id, 'target_label' FROM extra WHERE target = 'part:1'")
def graph_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken edges among good ones."""
    from graphloom.graph import PropertyGraph

    g, k = commerce_graph(spark, sf_dir), F.col("o_orderkey")
    own = F.concat(F.lit("order:"), k.cast("string"))
    bad = table(spark, sf_dir, "orders").where("o_orderkey % 100 < 6").select(F.concat(F.lit("bad|"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "ghost:1").otherwise(own).alias("source"), F.when(k % 3 == 1, "ghost:2").when(k % 3 == 2, "part:1").otherwise("customer:1").alias("target"), F.lit("PlacedBy").alias("kind"))
    return PropertyGraph(g.nodes, g.edges.unionByName(bad)).issues()


@query(f"WITH {COMMERCE}, used AS (SELECT 'part:' || l_partkey AS id FROM lineitem WHERE l_quantity > 49) SELECT id, name FROM nodes WHERE label = 'Part' AND id NOT IN (SELECT id FROM used)")
def dead_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large line asks for."""
    from graphloom.operators import traverse

    g = commerce_graph(spark, sf_dir)
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"), F.lit("Contains").alias("kind"))
    return traverse.untargeted(g.nodes.where("label = 'Part'"), used.unionByName(g.edges.where("kind = 'SuppliedBy'").select("target", "kind")), ("SuppliedBy",)).select("id", "name")
