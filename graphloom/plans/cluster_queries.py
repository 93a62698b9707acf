"""Queries over communities, clusters, layouts and orders of the commerce and link graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import clusters, findings, relational, resolve, traverse
from graphloom.plans.graph_queries import COMMERCE, LINKS, TRANSITIONS, _unrolled
from graphloom.plans.registry import query
from graphloom.sources.tables import commerce_graph, link_graph, table, transitions

#: Who bought from whom, of every fiftieth order, between nations.
TRADE = """
trade AS (SELECT 'buys:' || l_orderkey || ':' || l_linenumber AS id, 'customer:' || o_custkey AS source, 'supplier:' || l_suppkey AS target, CASE WHEN l_quantity > 25 THEN 'Bulk' ELSE 'Single' END AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 50 = 0),
members AS (SELECT 'customer:' || c_custkey AS id, 'nation:' || c_nationkey AS cluster FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier),
sides AS (SELECT t.id, t.source, t.target, t.kind, a.cluster AS a, b.cluster AS b FROM trade t LEFT JOIN members a ON a.id = t.source LEFT JOIN members b ON b.id = t.target)
"""


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda name: table(spark, sf_dir, name)
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    lines = t("lineitem").where("l_orderkey % 50 = 0").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ident = F.concat_ws(":", F.lit("buys"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    edges = lines.select(ident.alias("id"), named("customer:", "o_custkey").alias("source"), named("supplier:", "l_suppkey").alias("target"), F.when(F.col("l_quantity") > 25, "Bulk").otherwise("Single").alias("kind"))
    members = t("customer").select(named("customer:", "c_custkey").alias("id"), named("nation:", "c_nationkey").alias("cluster"))
    return members.unionByName(t("supplier").select(named("supplier:", "s_suppkey").alias("id"), named("nation:", "s_nationkey").alias("cluster"))), edges


@query(f"WITH {TRADE}, f AS (SELECT cluster, count(*) AS n FROM members GROUP BY cluster), s AS (SELECT a AS cluster, kind, CASE WHEN a = b THEN 'intra' ELSE 'outgoing' END AS what FROM sides UNION ALL SELECT b, kind, 'incoming' FROM sides WHERE a IS DISTINCT FROM b) SELECT f.cluster, n, array_to_string(list_sort(list(DISTINCT kind) FILTER (what = 'intra')), ',') AS kinds, count(*) FILTER (what = 'intra') AS intra, count(*) FILTER (what = 'incoming') AS incoming, count(*) FILTER (what = 'outgoing') AS outgoing, round(CASE WHEN n > 1 THEN least(1.0, count(*) FILTER (what = 'intra') / (n * (n - 1) / 2.0)) ELSE 0 END, 9) AS cohesion FROM f LEFT JOIN s ON s.cluster = f.cluster GROUP BY f.cluster, n")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.cluster_stats(*trade(spark, sf_dir))
    return out.withColumns({"kinds": F.when(F.size("kinds") > 0, F.array_join("kinds", ",")), "cohesion": F.round("cohesion", 9)})


@query(f"WITH {TRADE}, k AS (SELECT a, b, kind, count(*) AS n FROM sides WHERE a <> b GROUP BY ALL), e AS (SELECT a, b, string_agg(id, ',' ORDER BY id) AS ids FROM sides WHERE a <> b GROUP BY ALL) SELECT k.a AS source, k.b AS target, sum(n)::BIGINT AS n, string_agg(kind || ':' || n, ',' ORDER BY n DESC, kind) AS kinds, md5(any_value(ids)) AS edges FROM k JOIN e ON e.a = k.a AND e.b = k.b GROUP BY k.a, k.b")
def cluster_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between clusters with their kinds and edges."""
    out = clusters.cluster_links(*trade(spark, sf_dir))
    return out.select("source", "target", "n", F.array_join("kinds", ",").alias("kinds"), F.md5(F.array_join("edge_ids", ",").cast("binary")).alias("edges"))


@query(f"WITH {TRADE}, n AS (SELECT cluster AS community, count(*) AS members FROM members GROUP BY cluster HAVING count(*) > 1), c AS (SELECT n.community, n.members, (SELECT count(*) FROM sides WHERE a = n.community AND b = n.community) AS intra, (SELECT count(*) FROM sides WHERE (a = n.community) <> (b = n.community)) AS boundary, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT DISTINCT id FROM sides WHERE (a = n.community) <> (b = n.community))) AS edges, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT CASE WHEN a = n.community THEN source ELSE target END AS x FROM sides WHERE (a = n.community) <> (b = n.community))) AS bridges FROM n), d AS (SELECT m.id, m.cluster, (SELECT count(*) FROM sides WHERE a = m.cluster AND b = m.cluster AND source = m.id) + (SELECT count(*) FROM sides WHERE a = m.cluster AND b = m.cluster AND target = m.id) AS d FROM members m), r AS (SELECT cluster, string_agg(id, ',' ORDER BY d DESC, id) AS representatives FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d DESC, id) AS k FROM d) WHERE k <= 5 GROUP BY cluster) SELECT community, members, intra, boundary, round(least(1.0, intra / (members * (members - 1) / 2.0)), 9) AS cohesion, round(boundary / greatest(1, 2 * intra + boundary), 9) AS conductance, md5(coalesce(edges, '')) AS edges, md5(coalesce(bridges, '')) AS bridges, representatives FROM c JOIN r ON r.cluster = c.community")
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a community is like: cohesion, conductance, boundary edges, bridges and representatives."""
    members, edges = trade(spark, sf_dir)
    out = clusters.community_summary(members.withColumnRenamed("cluster", "community"), edges)
    digest = lambda c: F.md5(F.array_join(c, ",").cast("binary")).alias(c.split("_")[-1])
    return out.select("community", "members", "intra", "boundary", F.round("cohesion", 9).alias("cohesion"), F.round("conductance", 9).alias("conductance"), digest("boundary_edges"), digest("bridges"), F.array_join("representatives", ",").alias("representatives"))


@query(f"WITH {TRADE}, w AS (SELECT least(source, target) AS u, greatest(source, target) AS v, sum(CASE kind WHEN 'Bulk' THEN 4 ELSE 1 END)::BIGINT AS weight FROM trade WHERE source IN (SELECT id FROM members WHERE cluster < 'nation:2') GROUP BY ALL) SELECT * FROM w WHERE v IN (SELECT id FROM members WHERE cluster < 'nation:2') AND u IN (SELECT id FROM members WHERE cluster < 'nation:2')")
def scoped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a scope: kinds with weights, both ends within it; parallel edges add up."""
    members, edges = trade(spark, sf_dir)
    return clusters.weighted(edges, {"Bulk": 4, "Single": 1, "Never": 0}, members.where("cluster < 'nation:2'"))


@query()
def moved_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the trade by sequential local moving."""
    _, edges = trade(spark, sf_dir)
    return clusters.local_moving(clusters.weighted(edges, {"Bulk": 4, "Single": 1}))


@query(f"WITH {TRADE}, c AS (SELECT cluster FROM members GROUP BY cluster), s AS (SELECT a AS cluster, id, kind FROM sides WHERE a IS NOT NULL UNION SELECT b, id, kind FROM sides WHERE b IS NOT NULL), k AS (SELECT cluster, kind, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, kind) AS k FROM s GROUP BY cluster, kind), d AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM trade UNION ALL SELECT target FROM trade) GROUP BY id) SELECT c.cluster, (SELECT count(*) FROM sides WHERE (a = c.cluster) <> (b = c.cluster)) AS boundary, round((SELECT count(*) FROM sides WHERE (a = c.cluster) <> (b = c.cluster)) / greatest(1, 2 * (SELECT count(*) FROM sides WHERE a = c.cluster AND b = c.cluster) + (SELECT count(*) FROM sides WHERE (a = c.cluster) <> (b = c.cluster))), 9) AS conductance, coalesce((SELECT string_agg(kind, ',' ORDER BY k.k) FROM k WHERE k.cluster = c.cluster AND k.k <= 2), '') AS top_kinds, (SELECT count(*) FROM members m JOIN d ON d.id = m.id WHERE m.cluster = c.cluster AND d.n >= 8) AS tensions FROM c")
def slice_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, edges = trade(spark, sf_dir)
    busy = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").count().where("count >= 8").select("id", F.lit("Coupling").alias("category"))
    out = clusters.slice_insights(members, edges, busy)
    return out.withColumns({"conductance": F.round("conductance", 9), "top_kinds": F.array_join("top_kinds", ",")})


@query(f"WITH {TRADE} SELECT m.cluster AS module, count(DISTINCT m.id) AS members, count(DISTINCT t.id) AS incident, count(DISTINCT m.id) + count(DISTINCT t.id) AS score FROM members m LEFT JOIN trade t ON t.source = m.id OR t.target = m.id GROUP BY m.cluster")
def key_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, edges = trade(spark, sf_dir)
    return clusters.key_modules(members.withColumnRenamed("cluster", "module"), edges)


LAYOUT = f"""WITH {COMMERCE}, org AS (SELECT * FROM edges WHERE kind IN ('BelongsTo', 'PlacedBy')),
deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
{_unrolled(2, "SELECT 'nation:7' AS id, 0 AS hop", "SELECT id, hop FROM {last} UNION SELECT x.v, {k} FROM {last} JOIN (SELECT source AS u, target AS v FROM org UNION SELECT target, source FROM org) x ON x.u = id WHERE hop = {k} - 1 AND x.v NOT IN (SELECT id FROM {last})")},
cand AS (SELECT r2.id, hop, label, coalesce(degree, 0) AS degree FROM r2 JOIN nodes n ON n.id = r2.id LEFT JOIN deg ON deg.id = r2.id WHERE lower(label) IN ('customer', 'order') OR r2.id = 'nation:7'),
chosen AS (SELECT * FROM cand ORDER BY hop, degree DESC, id LIMIT 150)"""


@query(f"{LAYOUT}, p AS (SELECT *, (row_number() OVER (PARTITION BY hop ORDER BY id) - 1)::INTEGER AS place, count(*) OVER (PARTITION BY hop) AS n FROM chosen) SELECT id, label, degree, hop, place, round(hop * 120.0 * cos(2 * pi() * place / n), 4) + 0.0 AS x, round(hop * 120.0 * sin(2 * pi() * place / n), 4) + 0.0 AS y FROM p")
def layout_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout around a nation, within the least budget."""
    nodes, _, _ = clusters.layout(commerce_graph(spark, sf_dir), "nation:7", 2, ("Customer", "order"), ("BelongsTo", "PlacedBy"))
    return nodes.withColumns({"x": F.round("x", 4) + 0.0, "y": F.round("y", 4) + 0.0})


@query(f"{LAYOUT} SELECT (SELECT count(*) FROM cand) AS nodes_available, (SELECT count(*) FROM org WHERE source IN (SELECT id FROM chosen) AND target IN (SELECT id FROM chosen)) AS edges_available, (SELECT count(*) FROM cand) > 150 AS nodes_truncated, (SELECT count(*) FROM org WHERE source IN (SELECT id FROM chosen) AND target IN (SELECT id FROM chosen)) > 400 AS edges_truncated")
def layout_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.layout(commerce_graph(spark, sf_dir), "nation:7", 2, ("Customer", "order"), ("BelongsTo", "PlacedBy"))[2]


@query(f"{LAYOUT} SELECT what, name, n FROM (SELECT 'node' AS what, label AS name, count(*) AS n FROM chosen GROUP BY label UNION ALL SELECT 'edge', kind, count(*) FROM org WHERE source IN (SELECT id FROM chosen) AND target IN (SELECT id FROM chosen) GROUP BY kind)")
def slice_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and kinds of a layout's slice."""
    nodes, edges, _ = clusters.layout(commerce_graph(spark, sf_dir), "nation:7", 2, ("Customer", "order"), ("BelongsTo", "PlacedBy"))
    count = lambda df, what, c: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "name", "n")
    return count(nodes, "node", "label").unionByName(count(edges, "edge", "kind"))


@query(f"{LAYOUT} SELECT id, degree + CASE WHEN id = 'nation:7' THEN 10000 ELSE 0 END + CASE WHEN hop = 1 THEN 2000 ELSE 0 END AS priority FROM chosen ORDER BY priority DESC, id LIMIT 12")
def important_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, _ = clusters.layout(commerce_graph(spark, sf_dir), "nation:7", 2, ("Customer", "order"), ("BelongsTo", "PlacedBy"))
    priority = clusters.node_label_priority(F.col("degree"), F.col("id") == "nation:7", F.col("hop") == 1, F.col("label"))
    return nodes.select("id", priority.alias("priority")).orderBy(F.desc("priority"), "id").limit(12)


@query("WITH o AS (SELECT * FROM (VALUES (0, 'region:0', 'AFRICA'), (1, 'r', 'x')) AS t(position, id, component) WHERE false), n AS (SELECT 'nation:' || n_nationkey AS id, 'region:' || n_regionkey AS component FROM nation), c AS (SELECT component, count(*) AS n, row_number() OVER (ORDER BY component) AS k FROM n GROUP BY component) SELECT (sum(c2.n) - c1.n + row_number() OVER (PARTITION BY n.component ORDER BY n.id) - 1)::BIGINT AS position, n.id, n.component FROM n JOIN c c1 ON c1.component = n.component JOIN c c2 ON c2.k <= c1.k GROUP BY n.id, n.component, c1.n")
def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region, where each region points at the next."""
    nation = table(spark, sf_dir, "nation")
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    members = nation.select(named("nation:", "n_nationkey").alias("id"), named("region:", "n_regionkey").alias("component"))
    first = nation.groupBy("n_regionkey").agg(F.min(named("nation:", "n_nationkey")).alias("id"))
    edges = first.select(F.col("id").alias("source"), (F.col("n_regionkey") + 1).alias("k")).join(first.select(F.col("n_regionkey").alias("k"), F.col("id").alias("target")), "k").select("source", "target")
    return clusters.topological_order(members, edges)


@query(f"WITH {COMMERCE}, x AS (SELECT 'order:' || o_orderkey AS id, 1 AS hop FROM orders WHERE o_custkey = 1 UNION ALL SELECT 'customer:1', 0) SELECT 'c' AS root, id, hop FROM x")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on a customer."""
    root = spark.range(1).select(F.lit("c").alias("root"), F.lit("customer:1").alias("id"))
    return clusters.blast_radius(commerce_graph(spark, sf_dir).edges, root, ("PlacedBy", "BelongsTo"))


@query("WITH n AS (SELECT 'region:' || r_regionkey AS id, 'region:' || r_regionkey AS root, 'tree:region:' || r_regionkey AS grp FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'tree:region:' || n_regionkey FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'region:' || n_regionkey, 'tree:region:' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'part:' || p_partkey, 'part:' || p_partkey, 'kind:Part' FROM part) SELECT id, root, grp AS \"group\" FROM n")
def forest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tree each node is in; parts stand alone."""
    g = commerce_graph(spark, sf_dir)
    nodes = g.nodes.where("label IN ('Region', 'Nation', 'Customer', 'Part')").select("id", "label")
    parents = g.edges.where("kind = 'BelongsTo' AND NOT startswith(source, 'supplier')").select(F.col("source").alias("id"), F.col("target").alias("parent"))
    return clusters.forest_roots(nodes, parents)


@query(f"WITH {COMMERCE} SELECT 'm:' || c_custkey AS module, 'customer:' || c_custkey AS id FROM customer WHERE c_custkey < 20 UNION SELECT 'm:' || c_custkey, 'nation:' || c_nationkey FROM customer WHERE c_custkey < 20")
def member_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers reach without entering a region."""
    g = commerce_graph(spark, sf_dir)
    seeds = table(spark, sf_dir, "customer").where("c_custkey < 20").select(F.concat(F.lit("m:"), F.col("c_custkey").cast("string")).alias("module"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return clusters.member_expansion(seeds, g.edges, g.nodes.where("label = 'Region'").select("id"))


@query(f"WITH {TRADE} SELECT id, count(*) AS score FROM (SELECT source AS id FROM trade UNION ALL SELECT target FROM trade) WHERE id IN (SELECT source FROM sides WHERE a <> b UNION SELECT target FROM sides WHERE a <> b) GROUP BY id")
def boundary_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes between clusters with their degree as score."""
    members, edges = trade(spark, sf_dir)
    score = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("score"))
    return clusters.boundary_bridges(members, edges, score)


@query(f"WITH {TRADE}, own AS (SELECT id, cluster AS owner FROM members WHERE id LIKE 'customer:%' UNION ALL SELECT target, a FROM sides WHERE a IS NOT NULL), g AS (SELECT id, count(DISTINCT owner) AS n, min(owner) AS owner FROM own GROUP BY id) SELECT 'node' AS kind, m.id, CASE WHEN n = 1 THEN owner ELSE 'shared' END AS fragment FROM members m LEFT JOIN g ON g.id = m.id UNION ALL SELECT 'edge', t.id, CASE WHEN n = 1 THEN owner ELSE 'shared' END FROM trade t LEFT JOIN g ON g.id = t.source")
def owner_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers belong to their nation, suppliers to those who buy from them."""
    members, edges = trade(spark, sf_dir)
    buyers = edges.join(members.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("id"), F.col("cluster").alias("owner"))
    owners = members.where("id LIKE 'customer:%'").select("id", F.col("cluster").alias("owner")).unionByName(buyers)
    return clusters.owner_fragments(members, edges, owners)


@query(f"WITH {LINKS}, e AS (SELECT source, target FROM edges WHERE NOT starts_with(target, 'unresolved:')), x AS (SELECT target FROM edges WHERE starts_with(target, 'unresolved:')) SELECT DISTINCT target AS id FROM edges WHERE starts_with(target, 'unresolved:') EXCEPT SELECT target FROM edges WHERE source LIKE 'page:11%'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken targets that no page of some names."""
    edges = link_graph(spark, sf_dir).edges
    targets = lambda df: df.where("startswith(target, 'unresolved:')").select(F.col("target").alias("id"))
    return targets(edges).exceptAll(targets(edges).limit(0)).distinct().join(targets(edges.where("source LIKE 'page:11%'")).distinct(), "id", "left_anti")


@query(f"WITH {COMMERCE}, extra AS (SELECT 'unresolved:' || k AS id FROM range(5) t(k)), named AS (SELECT 'unresolved:' || (o_orderkey % 3) AS id FROM orders) SELECT id FROM extra WHERE id IN (SELECT id FROM named)")
def referenced_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved nodes that no edge names are pruned."""
    ids = spark.range(5).select(F.concat(F.lit("unresolved:"), F.col("id").cast("string")).alias("id"))
    nodes = ids.select("id", F.lit("Unresolved").alias("label"), F.col("id").alias("name"), F.lit(None).cast("string").alias("path"))
    target = F.concat(F.lit("unresolved:"), (F.col("o_orderkey") % 3).cast("string"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("x").alias("source"), target.alias("target"), F.lit("References").alias("kind"))
    return PropertyGraph(nodes, edges).pruned().nodes.select("id")


@query("WITH d AS (SELECT p_partkey AS k, 'f' || (p_partkey % 50) AS file FROM part), w AS (SELECT DISTINCT 'index' AS file, 'n' || (k % 10) AS name FROM d), e AS (SELECT 'index' AS file, '*' AS name) SELECT 'index' AS file, 'n' || k AS name, 'deep' || (k % 2) AS origin, CASE WHEN k % 2 = 0 THEN 'n' || k ELSE 'm' || k END AS origin_name, (CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END)::INTEGER AS depth FROM range(10) t(k)")
def re_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names chased through files that pass them on, with renames and a circle."""
    k = spark.range(10)
    name = lambda p: F.concat(F.lit(p), F.col("id").cast("string"))
    wanted = k.select(F.lit("index").alias("file"), name("n").alias("name"))
    renamed = k.where("id % 2 = 1").select(F.lit("index").alias("file"), name("n").alias("name"), F.lit("deep1").alias("from_file"), name("m").alias("from_name"))
    passed = spark.createDataFrame([("index", "*", "middle", "*"), ("middle", "*", "deep0", "*"), ("middle", "*", "index", "*")], "file string, name string, from_file string, from_name string")
    defined = k.where("id % 2 = 0").select(F.lit("deep0").alias("file"), name("n").alias("name")).unionByName(k.where("id % 2 = 1").select(F.lit("deep1").alias("file"), name("m").alias("name")))
    return resolve.re_exports(wanted, renamed.unionByName(passed), defined)


@query("WITH c AS (SELECT p_partkey AS k FROM part) SELECT 'file' || k AS file, 'x' AS receiver, CASE WHEN k % 2 = 0 THEN 'run' ELSE 'stop' END AS method, 'C' || (k % 3) AS class, CASE WHEN k % 2 = 0 THEN (CASE WHEN k % 3 = 0 THEN 'C0' ELSE 'Base' END) ELSE 'Root' END AS owner, (CASE WHEN k % 2 = 0 THEN (CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END) ELSE 2 END)::INTEGER AS depth FROM c")
def member_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on bound receivers, resolved through the classes above."""
    k = F.col("p_partkey")
    calls = table(spark, sf_dir, "part").select(F.concat(F.lit("file"), k.cast("string")).alias("file"), F.lit("x").alias("receiver"), F.when(k % 2 == 0, "run").otherwise("stop").alias("method"), F.concat(F.lit("C"), (k % 3).cast("string")).alias("class"))
    inherits = spark.createDataFrame([("C0", "Base"), ("C1", "Base"), ("C2", "Base"), ("Base", "Root"), ("Root", "C0")], "class string, base string")
    methods = spark.createDataFrame([("C0", "run"), ("Base", "run"), ("Root", "stop")], "class string, method string")
    return resolve.member_calls(calls.drop("class"), calls.select("file", "receiver", "class"), inherits, methods)


@query(f"WITH {COMMERCE} SELECT id, CASE WHEN starts_with(id, 'region:') THEN 2 WHEN starts_with(id, 'nation:') THEN CASE WHEN id IN (SELECT target FROM edges WHERE kind = 'BelongsTo') THEN 1 ELSE 0 END ELSE 0 END AS layer FROM nodes WHERE id IN (SELECT source FROM edges WHERE kind = 'BelongsTo' UNION SELECT target FROM edges WHERE kind = 'BelongsTo')")
def topological_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.topological_layers(commerce_graph(spark, sf_dir).kinds("BelongsTo").edges)


@query(f"WITH {TRADE}, e AS (SELECT id, source, target, kind FROM trade UNION ALL SELECT 'co:' || n_nationkey || ':' || k, 'nation:' || n_nationkey, 'nation:' || ((n_nationkey + k) % 25), 'FileChangesWith' FROM nation, range(1, 4) t(k)), l AS (SELECT 'nation:' || n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'Ui' WHEN 1 THEN 'Api' WHEN 2 THEN 'Domain' ELSE 'Data' END AS layer, 1 + n_nationkey % 4 AS p FROM nation), f AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM e WHERE kind = 'FileChangesWith' AND source <> target) SELECT 'HiddenCoupling' AS rule, a || '|' || b AS id FROM f UNION ALL SELECT 'ShotgunSurgery', id FROM (SELECT a AS id FROM f UNION ALL SELECT b FROM f) GROUP BY id HAVING count(*) >= 5 UNION ALL SELECT DISTINCT 'LayerViolation', source || '|' || target FROM e JOIN l x ON x.id = source JOIN l y ON y.id = target WHERE x.p > y.p UNION ALL SELECT 'LowCohesion', '7' UNION ALL SELECT DISTINCT 'Cycle', x.source || '|' || x.target FROM e x JOIN e y ON x.source = y.target AND x.target = y.source WHERE x.source < x.target")
def architecture_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden coupling, changes that spread, edges up the layers, loose communities."""
    _, edges = trade(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    named = lambda c: F.concat(F.lit("nation:"), c.cast("string"))
    together = nation.select(k, F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("step")).select(F.concat_ws(":", F.lit("co"), k.cast("string"), F.col("step").cast("string")).alias("id"), named(k).alias("source"), named((k + F.col("step")) % 25).alias("target"), F.lit("FileChangesWith").alias("kind"))
    layer = F.when(k % 4 == 0, "Ui").when(k % 4 == 1, "Api").when(k % 4 == 2, "Domain").otherwise("Data")
    cohesion = spark.createDataFrame([(7, 0.25), (8, 0.26)], "community long, cohesion double")
    degree = edges.limit(0).select("id", F.lit(1).alias("degree"))
    return findings.health(degree, edges.unionByName(together), cohesion, layers=nation.select(named(k).alias("id"), layer.alias("layer")))


@query(f"WITH {TRANSITIONS}, n AS (SELECT source, target, n FROM moves) SELECT source, target, n, n >= 3 AS proven FROM n WHERE n >= 3 OR source = target")
def proven_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with enough evidence, and loops."""
    moves = transitions(spark, sf_dir).withColumn("proven", F.col("n") >= 3)
    return moves.where("proven OR source = target")


@query(f"WITH {COMMERCE}, a AS (SELECT 'SELECT' AS kind, 'x' AS y WHERE false), e AS (SELECT DISTINCT name, min(id) AS id FROM nodes WHERE label = 'Part' GROUP BY name ORDER BY name LIMIT 20) SELECT 'entry' AS what, id, name FROM e UNION ALL SELECT 'boundary', id, name FROM (SELECT id, name FROM nodes WHERE label = 'Supplier' ORDER BY id LIMIT 30)")
def architecture_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points (each text once, with its least id) and boundaries, up to 20 and 30."""
    nodes = commerce_graph(spark, sf_dir).nodes
    entries = nodes.where("label = 'Part'").groupBy("name").agg(F.min("id").alias("id")).orderBy("name").limit(20)
    edge = nodes.where("label = 'Supplier'").select("id", "name").orderBy("id").limit(30)
    return entries.select(F.lit("entry").alias("what"), "id", "name").unionByName(edge.select(F.lit("boundary").alias("what"), "id", "name"))


@query(f"WITH {COMMERCE}, {_unrolled(2, "SELECT 'customer:1' AS id, 0 AS hop", "SELECT {last}.id, hop FROM {last} UNION SELECT e.source, {k} FROM {last} JOIN edges e ON e.target = {last}.id AND e.kind IN ('PlacedBy', 'BelongsTo') WHERE hop = {k} - 1 AND e.source NOT IN (SELECT id FROM {last})")} SELECT id, hop FROM r2")
def bounded_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops against the edges of some kinds."""
    g = commerce_graph(spark, sf_dir).kinds("PlacedBy", "BelongsTo")
    start = g.nodes.where("id = 'customer:1'").select(F.col("id").alias("root"), "id")
    return traverse.hops(g.edges, start, "in", 2).select("id", "hop")


@query(f"WITH {COMMERCE}, w AS (SELECT 'order:' || o_orderkey AS key, md5(o_orderstatus) AS digest FROM orders WHERE o_orderkey % 7 <> 0), s AS (SELECT 'order:' || o_orderkey AS key, md5(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END) AS digest FROM orders WHERE o_orderkey % 11 <> 0) SELECT coalesce(w.key, s.key) AS key, CASE WHEN s.key IS NULL THEN 'rebuilt' WHEN w.key IS NULL THEN 'removed' WHEN w.digest = s.digest THEN 'kept' ELSE 'rebuilt' END AS action FROM w FULL JOIN s ON s.key = w.key")
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments bound to digests: kept, rebuilt, removed."""
    orders = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key")
    digest = lambda c: F.md5(c.cast("binary")).alias("digest")
    wanted = orders.where("o_orderkey % 7 <> 0").select(key, digest(F.col("o_orderstatus")))
    stored = orders.where("o_orderkey % 11 <> 0").select(key, digest(F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_orderstatus"))))
    renamed = {"reused": "kept", "computed": "rebuilt", "dropped": "removed"}
    names = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair])
    return relational.cache_plan(wanted, stored).select("key", names[F.col("action")].alias("action"))
