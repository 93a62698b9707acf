"""Queries over the commerce, link and transition graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import analytics, components, findings, incremental, relational, traverse
from graphloom.plans import match
from graphloom.plans.registry import query
from graphloom.sources.tables import commerce_graph, link_graph, table, transitions

COMMERCE = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order', 'Order#' || o_orderkey FROM orders
), ends AS (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'BelongsTo' AS kind, NULL AS key FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'BelongsTo', NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BelongsTo', NULL FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'PlacedBy', NULL FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'Contains', CAST(l_linenumber AS VARCHAR) FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SuppliedBy', NULL FROM lineitem
), edges AS (SELECT concat_ws('|', kind, source, target, key) AS id, source, target, kind FROM ends)
"""

LINKS = """
pages_ AS (SELECT 'page:' || page_id AS id, url AS name, regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
by_path AS (SELECT path, min(id) AS page FROM pages_ GROUP BY path),
hrefs AS (SELECT id AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos FROM pages_),
edges AS (
  SELECT 'References|' || source || '|' || pos AS id, source, coalesce(page, 'unresolved:' || href) AS target, 'References' AS kind
  FROM hrefs LEFT JOIN by_path ON hrefs.href = by_path.path
), nodes AS (
  SELECT id, 'Page' AS label, name FROM pages_
  UNION ALL SELECT DISTINCT target, 'Unresolved', substr(target, 12) FROM edges WHERE starts_with(target, 'unresolved:')
)
"""

TRANSITIONS = """
steps AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events),
moves AS (SELECT source, target, count(*) AS n FROM steps WHERE target IS NOT NULL GROUP BY ALL)
"""

ORGANISATION = ("BelongsTo", "PlacedBy")


def _unrolled(rounds: int, first: str, step: str) -> str:
    """CTEs r0 to r<rounds>; {last} in the step is the one before."""
    out = [f"r0 AS MATERIALIZED ({first})"]
    out += [f"r{k} AS MATERIALIZED ({step.format(last=f'r{k - 1}', k=k)})" for k in range(1, rounds + 1)]
    return ", ".join(out)


PLACED = 'MATCH (o:Order)-[:PlacedBy]->(c:Customer) WHERE c.name CONTAINS "77" RETURN o, c'


@query(f"WITH {COMMERCE} SELECT DISTINCT e.source AS o, a.name AS o_name, e.target AS c, b.name AS c_name FROM edges e JOIN nodes a ON a.id = e.source AND a.label = 'Order' JOIN nodes b ON b.id = e.target AND b.label = 'Customer' WHERE e.kind = 'PlacedBy' AND contains(lower(b.name), '77')")
def match_orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.run(commerce_graph(spark, sf_dir), PLACED)


CHAIN = 'MATCH (r:Region)<-[:BelongsTo]-(n:Nation)<-[:BelongsTo]-(s:Supplier) WHERE r.name = "ASIA" RETURN n, s'


@query(f"WITH {COMMERCE} SELECT DISTINCT n.id AS n, n.name AS n_name, s.id AS s, s.name AS s_name FROM nodes r JOIN edges e ON e.target = r.id AND e.kind = 'BelongsTo' JOIN nodes n ON n.id = e.source AND n.label = 'Nation' JOIN edges f ON f.target = n.id AND f.kind = 'BelongsTo' JOIN nodes s ON s.id = f.source AND s.label = 'Supplier' WHERE r.label = 'Region' AND r.name = 'ASIA'")
def match_suppliers_of_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.run(commerce_graph(spark, sf_dir), CHAIN)


@query(f"WITH {LINKS} SELECT coalesce(n.id, x.id) AS id, coalesce(i, 0)::BIGINT AS in_degree, coalesce(o, 0)::BIGINT AS out_degree FROM nodes n FULL JOIN (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT source AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges) GROUP BY id) x ON x.id = n.id")
def degree_of_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.degrees(link_graph(spark, sf_dir), dangling=True)


@query(f"WITH {COMMERCE} SELECT n.id, (SELECT count(*) FROM edges WHERE target = n.id) AS in_degree, (SELECT count(*) FROM edges WHERE source = n.id) AS out_degree FROM nodes n")
def degree_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.degrees(commerce_graph(spark, sf_dir))


@query(f"WITH {COMMERCE} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
def degree_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = commerce_graph(spark, sf_dir).edges
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


@query(f"WITH {COMMERCE}, p AS (SELECT e.kind, '(' || coalesce(a.label, 'Unknown') || ')-[' || e.kind || ']->(' || coalesce(b.label, 'Unknown') || ')' AS pattern FROM edges e LEFT JOIN nodes a ON a.id = e.source LEFT JOIN nodes b ON b.id = e.target) SELECT 'label' AS what, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'kind', kind, count(*) FROM p GROUP BY kind UNION ALL SELECT 'pattern', pattern, count(*) FROM p GROUP BY pattern")
def graph_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.schema_summary(commerce_graph(spark, sf_dir))


@query(f"WITH {COMMERCE}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) SELECT n.id, label, name, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d ON d.id = n.id WHERE lower(label) = 'customer' AND contains(lower(name || ' ' || n.id), '12') ORDER BY degree DESC, label, name, n.id LIMIT 25")
def search_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 25 of a label whose text contains a word, by degree."""
    g = commerce_graph(spark, sf_dir)
    d = analytics.degrees(g)
    hits = g.nodes.where((F.lower("label") == "customer") & F.lower(F.concat_ws(" ", "name", "id")).contains("12"))
    found = hits.join(d, "id").select("id", "label", "name", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    return found.orderBy(F.desc("degree"), "label", "name", "id").limit(25)


@query(f"WITH {COMMERCE}, q(word) AS (VALUES ('nation:3'), ('ASIA'), ('customer#000000012'), ('nothing')) SELECT word, id FROM (SELECT word, id, row_number() OVER (PARTITION BY word ORDER BY CASE WHEN id = word THEN 1 WHEN name = word THEN 2 ELSE 3 END, id) AS k FROM q JOIN nodes ON id = word OR name = word OR contains(lower(name || ' ' || id), lower(word))) WHERE k = 1")
def root_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node a word names: by id, else by name, else the first that contains it."""
    nodes = commerce_graph(spark, sf_dir).nodes
    words = ("nation:3", "ASIA", "customer#000000012", "nothing")
    text = F.lower(F.concat_ws(" ", "name", "id"))
    how = lambda w: F.when(F.col("id") == w, 1).when(F.col("name") == w, 2).when(text.contains(w.lower()), 3)
    tried = nodes.select("id", F.explode(F.array(*[F.struct(F.lit(w).alias("word"), how(w).alias("how")) for w in words])).alias("x"))
    return tried.where("x.how IS NOT NULL").groupBy("x.word").agg(F.min(F.struct("x.how", "id")).alias("best")).select("word", "best.id")


@query(f"WITH {LINKS} SELECT id, source, target FROM edges WHERE NOT starts_with(target, 'unresolved:')")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph(spark, sf_dir).resolved().edges.select("id", "source", "target")


@query(f"WITH {LINKS} SELECT target AS id, count(*) AS inbound, count(DISTINCT source) AS pages FROM edges WHERE starts_with(target, 'unresolved:') GROUP BY target")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = link_graph(spark, sf_dir)
    gone = g.nodes.where("label = 'Unresolved'").select(F.col("id").alias("target"))
    return g.edges.join(gone, "target").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("inbound"), F.count_distinct("source").alias("pages"))


@query(f"WITH {LINKS} SELECT target AS id, count(*) AS inbound FROM edges WHERE starts_with(target, 'unresolved:') GROUP BY target ORDER BY inbound DESC, id LIMIT 20")
def unresolved_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_links(spark, sf_dir).drop("pages").orderBy(F.desc("inbound"), "id").limit(20)


@query(f"WITH {LINKS} SELECT (SELECT count(*) FROM nodes) AS n_nodes, count(*) AS n_edges, count(*) FILTER (NOT starts_with(target, 'unresolved:')) AS resolved, (count(*) FILTER (NOT starts_with(target, 'unresolved:')) * 1000 // greatest(count(*), 1)) AS resolved_tenths FROM edges")
def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = link_graph(spark, sf_dir)
    ok = F.count_if(~F.col("target").startswith("unresolved:"))
    edges = g.edges.agg(F.count(F.lit(1)).alias("n_edges"), ok.alias("resolved"), F.call_function("div", ok * 1000, F.greatest(F.count(F.lit(1)), F.lit(1))).alias("resolved_tenths"))
    return edges.crossJoin(g.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))).select("n_nodes", "n_edges", "resolved", "resolved_tenths")


NATION_OF = "own AS (SELECT 'customer:' || c_custkey AS id, 'nation:' || c_nationkey AS owner FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'order:' || o_orderkey, 'nation:' || c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey)"


@query(f"WITH {NATION_OF} SELECT a.owner AS source_owner, b.owner AS target_owner, count(*) AS n FROM lineitem JOIN own a ON a.id = 'order:' || l_orderkey JOIN own b ON b.id = 'supplier:' || l_suppkey WHERE a.owner <> b.owner GROUP BY ALL")
def dependency_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines go from suppliers of one nation to customers of another."""
    g = commerce_graph(spark, sf_dir).kinds(*ORGANISATION)
    owners = traverse.climb(g.nodes.where("label IN ('Customer', 'Supplier', 'Order', 'Nation')"), g.edges, "Nation").select("id", "owner")
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("target")
    )
    return analytics.dependency_matrix(owners, lines)


@query(f"WITH {COMMERCE} SELECT kind, 'in' AS direction, source AS id FROM edges WHERE target = 'nation:7' UNION SELECT kind, 'out', target FROM edges WHERE source = 'nation:7'")
def explain_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of a node by kind and direction."""
    e = commerce_graph(spark, sf_dir).edges
    near = lambda here, there, name: e.where(F.col(here) == "nation:7").select("kind", F.lit(name).alias("direction"), F.col(there).alias("id"))
    return near("target", "source", "in").unionByName(near("source", "target", "out")).distinct()


BFS = "SELECT id, hop FROM {last} UNION SELECT x.v, {k} FROM {last} JOIN (SELECT source AS u, target AS v FROM org UNION SELECT target, source FROM org) x ON x.u = id WHERE hop = {k} - 1 AND x.v NOT IN (SELECT id FROM {last})"
INBOUND = "SELECT root, id, hop FROM {last} UNION SELECT l.root, e.source, {k} FROM {last} l JOIN org e ON e.target = l.id WHERE l.hop = {k} - 1 AND NOT EXISTS (SELECT 1 FROM {last} s WHERE s.root = l.root AND s.id = e.source)"
ORG = "org AS (SELECT * FROM edges WHERE kind IN ('BelongsTo', 'PlacedBy'))"


@query(f"WITH {COMMERCE}, {ORG}, {_unrolled(3, 'SELECT ' + chr(39) + 'nation:7' + chr(39) + ' AS id, 0 AS hop', BFS)} SELECT n.id, n.label, n.name, hop FROM r3 JOIN nodes n ON n.id = r3.id")
def trace_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within three hops of a nation either way."""
    return traverse.trace(commerce_graph(spark, sf_dir).kinds(*ORGANISATION), "nation:7", "both", 3)[0]


@query(f"WITH {COMMERCE}, {ORG}, {_unrolled(2, 'SELECT ' + chr(39) + 'nation:7' + chr(39) + ' AS id, 0 AS hop', BFS)} SELECT id, source, target, kind FROM org WHERE source IN (SELECT id FROM r2) AND target IN (SELECT id FROM r2)")
def trace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.trace(commerce_graph(spark, sf_dir).kinds(*ORGANISATION), "nation:7", "both", 2)[1]


@query(f"WITH {COMMERCE}, {ORG}, {_unrolled(3, 'SELECT id AS root, id, 0 AS hop FROM nodes WHERE id = ' + chr(39) + 'region:2' + chr(39), INBOUND)} SELECT n.id, n.label, n.name, hop FROM r3 JOIN nodes n ON n.id = r3.id")
def impact_of_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.impact(commerce_graph(spark, sf_dir).kinds(*ORGANISATION), "region:2", 3)


@query(f"WITH {COMMERCE}, {ORG}, t(target) AS (VALUES ('nation:1'), ('nation:2'), ('nation:999')), {_unrolled(2, 'SELECT target AS root, id, 0 AS hop FROM t JOIN nodes ON id = target', INBOUND)} SELECT t.target, id, hop FROM t LEFT JOIN r2 ON root = t.target")
def affected_by_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.range(1).select(F.explode(F.array(F.lit("nation:1"), F.lit("nation:2"), F.lit("nation:999"))).alias("target"))
    return traverse.affected(commerce_graph(spark, sf_dir).kinds(*ORGANISATION), targets, 2)


PATHS = "SELECT id, trail, hop FROM {last} UNION ALL SELECT v, min(trail || [v]), {k} FROM {last} JOIN (SELECT source AS u, target AS v FROM org UNION SELECT target, source FROM org) x ON x.u = id WHERE hop = {k} - 1 AND v NOT IN (SELECT id FROM {last}) GROUP BY v"


FIRST_TRAIL = "SELECT 'customer:1' AS id, ['customer:1'] AS trail, 0 AS hop"


@query(f"WITH {COMMERCE}, org AS (SELECT * FROM edges), {_unrolled(5, FIRST_TRAIL, PATHS)}, p AS (SELECT trail FROM r5 WHERE id = 'supplier:5'), h AS (SELECT unnest(range(1, len(trail))) AS hop, trail FROM p) SELECT hop::INTEGER AS hop, trail[hop] AS source, trail[hop + 1] AS target, (SELECT min(o.id) FROM org o WHERE (o.source = trail[hop] AND o.target = trail[hop + 1]) OR (o.source = trail[hop + 1] AND o.target = trail[hop])) AS edge_id FROM h")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.shortest_path(commerce_graph(spark, sf_dir), "customer:1", "supplier:5")


@query(f"WITH RECURSIVE {LINKS}, both_ AS (SELECT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges), reach(id, root) AS (SELECT u, u FROM both_ UNION SELECT both_.v, reach.root FROM reach JOIN both_ ON both_.u = reach.id) SELECT id AS node, min(root) AS root FROM reach GROUP BY id")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = link_graph(spark, sf_dir).edges
    return components.components(edges.select(F.col("source").alias("u"), F.col("target").alias("v")))


@query(f"WITH RECURSIVE {TRANSITIONS}, reach(a, b) AS (SELECT source, target FROM moves UNION SELECT a, target FROM reach JOIN moves ON source = b) SELECT x.a AS id, min(x.b) AS component, count(*) AS members FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.strong_components(transitions(spark, sf_dir))


@query(f"WITH RECURSIVE {COMMERCE}, org AS (SELECT source, target FROM edges WHERE kind = 'BelongsTo'), reach(root, id, hop) AS (SELECT source, target, 1 FROM org UNION ALL SELECT root, target, hop + 1 FROM reach JOIN org ON source = id) SELECT root, id, min(hop) AS hop FROM reach GROUP BY ALL")
def closure_of_belonging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.closure(commerce_graph(spark, sf_dir).kinds("BelongsTo").edges)


@query("SELECT 'customer:' || c_custkey AS id, 'region:' || n_regionkey AS owner, 2 AS hop FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 1 FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0 FROM region UNION ALL SELECT 'order:' || o_orderkey, 'region:' || n_regionkey, 3 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def containment_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of every node that has one."""
    g = commerce_graph(spark, sf_dir).kinds(*ORGANISATION)
    return traverse.climb(g.nodes, g.edges, "Region")


RANKS = "SELECT n.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce((s.share), 0) AS rank FROM nodes n LEFT JOIN (SELECT target, sum(rank / n_out) AS share FROM links JOIN {last} ON {last}.id = links.source GROUP BY target) s ON s.target = n.id"


@query(f"WITH {LINKS}, d AS (SELECT DISTINCT source, target FROM edges), links AS MATERIALIZED (SELECT source, target, count(*) OVER (PARTITION BY source) AS n_out FROM d), {_unrolled(20, 'SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes', RANKS)} SELECT id, round(rank, 9) AS rank FROM r20")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pagerank(link_graph(spark, sf_dir)).select("id", F.round("rank", 9).alias("rank"))


@query()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = link_graph(spark, sf_dir)
    both = g.edges.unionByName(g.edges.select("id", F.col("target").alias("source"), F.col("source").alias("target"), "kind"))
    return analytics.betweenness(PropertyGraph(g.nodes, both)).select("id", F.round("score", 6).alias("score"))


@query()
def link_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = link_graph(spark, sf_dir).edges
    return analytics.communities(edges.select(F.col("source").alias("u"), F.col("target").alias("v"), F.lit(1).alias("weight")))


@query(f"WITH {COMMERCE}, m AS (SELECT 'nation:' || n_nationkey AS id, 'region:' || n_regionkey AS community FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'customer:' || c_custkey, 'region:' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey FROM region UNION ALL SELECT 'order:' || o_orderkey, 'region:' || n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), supply AS (SELECT 'order:' || l_orderkey AS source, 'supplier:' || l_suppkey AS target FROM lineitem), e AS (SELECT a.community AS a, b.community AS b FROM supply JOIN m a ON a.id = source JOIN m b ON b.id = target), c AS (SELECT community, count(*) AS members FROM m GROUP BY community), k AS (SELECT community, members, (SELECT count(*) FROM e WHERE a = community AND b = community) AS intra, (SELECT count(*) FROM e WHERE (a = community) <> (b = community)) AS boundary FROM c) SELECT *, round(least(1.0, intra / (members * (members - 1) / 2.0)), 9) AS cohesion, round(boundary / greatest(1, 2 * intra + boundary), 9) AS conductance FROM k")
def community_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as communities of who buys from whom."""
    members = containment_climb(spark, sf_dir).select("id", F.col("owner").alias("community"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("target")
    )
    s = analytics.community_stats(members, lines)
    return s.select("community", "members", "intra", "boundary", F.round("cohesion", 9).alias("cohesion"), F.round("conductance", 9).alias("conductance"))


@query(f"WITH {COMMERCE}, {ORG}, {_unrolled(2, 'SELECT ' + chr(39) + 'region:1' + chr(39) + ' AS id, 0 AS hop', BFS)}, p AS (SELECT id, hop, (row_number() OVER (PARTITION BY hop ORDER BY id) - 1)::INTEGER AS place, count(*) OVER (PARTITION BY hop) AS n FROM r2) SELECT id, hop, place, round(hop * 120.0 * cos(2 * pi() * place / n), 4) AS x, round(hop * 120.0 * sin(2 * pi() * place / n), 4) AS y FROM p")
def ring_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = traverse.trace(commerce_graph(spark, sf_dir).kinds(*ORGANISATION), "region:1", "both", 2)
    return traverse.rings(nodes.select("id", "hop")).select("id", "hop", "place", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"WITH {COMMERCE}, {ORG}, d AS (SELECT id, (SELECT count(*) FROM org WHERE source = nodes.id) + (SELECT count(*) FROM org WHERE target = nodes.id) AS degree FROM nodes) SELECT 'Orphan' AS rule, id FROM d WHERE degree = 0 UNION ALL SELECT 'GodClass', id FROM d WHERE degree >= 12 UNION ALL SELECT 'Bridge', id FROM d WHERE degree >= 8 UNION ALL SELECT DISTINCT 'Cycle', a.source || '|' || a.target FROM org a JOIN org b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target")
def health_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce_graph(spark, sf_dir).kinds(*ORGANISATION)
    degree = analytics.degrees(g).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    return findings.health(degree, g.edges)


@query(f"WITH {COMMERCE}, {ORG}, d AS (SELECT id, (SELECT count(*) FROM org WHERE source = nodes.id) + (SELECT count(*) FROM org WHERE target = nodes.id) AS degree FROM nodes) SELECT 'DeadWeight' AS category, id FROM d WHERE degree = 0 UNION ALL SELECT 'Complexity', id FROM d WHERE degree >= 12 UNION ALL SELECT 'Coupling', id FROM d WHERE degree >= 8 UNION ALL SELECT 'BlastRadius', id FROM d WHERE degree >= 8")
def tensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.tensions(health_findings(spark, sf_dir))


TAGS = "tags AS (SELECT 'customer:' || c_custkey AS entity_id, 'segment' AS namespace, c_mktsegment AS value FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'credit', CASE WHEN c_acctbal < 0 THEN 'bad' ELSE 'good' END FROM customer)"


def customer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda ns, v: F.struct(F.lit(ns).alias("namespace"), v.cast("string").alias("value"))
    made = F.array(tag("segment", F.col("c_mktsegment")), tag("nation", F.col("c_nationkey")), tag("credit", F.when(F.col("c_acctbal") < 0, "bad").otherwise("good")))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("entity_id"), F.explode(made).alias("t"))
    return rows.select("entity_id", "t.namespace", "t.value")


@query(f"WITH {TAGS} SELECT namespace || ':' || value AS tag, count(*) AS n FROM tags GROUP BY ALL")
def tag_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.tag_facets(customer_tags(spark, sf_dir))


@query(f"WITH {TAGS}, h AS (SELECT entity_id, list(namespace || ':' || value) AS t FROM tags GROUP BY entity_id) SELECT entity_id FROM h WHERE (list_contains(t, 'segment:BUILDING') AND NOT list_contains(t, 'credit:bad')) OR (list_contains(t, 'nation:7') AND list_contains(t, 'credit:bad'))")
def tag_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.resolve_tags(customer_tags(spark, sf_dir), "segment:BUILDING, !credit:bad; nation:7, credit:bad")


@query(f"WITH {TAGS} SELECT DISTINCT namespace || ':' || value AS tag FROM tags WHERE starts_with(namespace || ':' || value, 'nation:1')")
def tag_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat_ws(":", "namespace", "value")
    return customer_tags(spark, sf_dir).select(tag.alias("tag")).where(F.col("tag").startswith("nation:1")).distinct()


@query(f"WITH {COMMERCE}, {TAGS}, t AS (SELECT entity_id FROM tags WHERE namespace = 'credit' AND value = 'bad') SELECT id, source, target, kind FROM edges WHERE source IN (SELECT * FROM t) OR target IN (SELECT * FROM t)")
def tagged_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with an end that has a tag."""
    edges = commerce_graph(spark, sf_dir).edges
    some = findings.resolve_tags(customer_tags(spark, sf_dir), "credit:bad").withColumn("hit", F.lit(True))
    for end in ("source", "target"):
        edges = edges.join(some.select(F.col("entity_id").alias(end), F.col("hit").alias(f"{end}_hit")), end, "left")
    return edges.where("source_hit OR target_hit").select("id", "source", "target", "kind")


@query(f"WITH {TRANSITIONS}, k AS (SELECT DISTINCT event_type AS name FROM events) SELECT x.name AS a, y.name AS b, coalesce(n, 0) AS n FROM k x JOIN k y ON x.name <> y.name LEFT JOIN moves ON source = x.name AND target = y.name")
def coupling_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = transitions(spark, sf_dir).select(F.col("source").alias("a"), F.col("target").alias("b"), "n")
    return relational.coupling_matrix(table(spark, sf_dir, "events").select(F.col("event_type").alias("name")), cells)


@query(f"WITH {COMMERCE}, s AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') SELECT c_custkey AS custkey FROM s")
def scope_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").alias("custkey")
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("custkey"))
    return c.where("c_mktsegment = 'MACHINERY'").select(key).intersect(c.where("c_nationkey < 10").select(key)).intersect(open_)


@query("WITH a AS (SELECT l_orderkey AS k, round(sum(l_quantity), 2) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT l_orderkey AS k, round(sum(l_quantity), 2) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity > 5 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return relational.snapshot_diff(old, new, "k", "v")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    total = lambda df: df.groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("v"))
    return total(lines.where("l_shipdate < '1996-01-01'")), total(lines.where("l_shipdate < '1997-01-01' AND l_quantity > 5"))


@query("WITH a AS (SELECT l_orderkey AS k, round(sum(l_quantity), 2) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT l_orderkey AS k, round(sum(l_quantity), 2) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity > 5 GROUP BY 1), j AS (SELECT a.k AS x, b.k AS y, a.v AS v, b.v AS w FROM a FULL JOIN b ON a.k = b.k) SELECT count(*) FILTER (x IS NULL) AS inserted, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND v IS DISTINCT FROM w) AS updated, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND v IS NOT DISTINCT FROM w) AS reused, count(*) FILTER (y IS NULL) AS deleted, count(*) FILTER (y IS NOT NULL) AS total FROM j")
def reconcile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return incremental.reconcile_metrics(old, new, "k", "v")


@query("WITH s AS (SELECT p_brand AS key, p_type AS content, 'shop/' || p_size || '/' || p_partkey AS owner FROM part), i AS (SELECT p_brand AS key, upper(p_type) AS content, 'shop/7/' || p_partkey AS owner FROM part WHERE p_size = 8), k AS (SELECT * FROM s WHERE NOT (owner = 'shop/7' OR starts_with(owner, 'shop/7/')) UNION ALL SELECT * FROM i), n AS (SELECT key, arg_min(content, owner) AS c, count(DISTINCT content) > 1 AS conflict FROM k GROUP BY key), o AS (SELECT key, arg_min(content, owner) AS c FROM s GROUP BY key) SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'Insert' WHEN n.key IS NULL THEN 'Delete' WHEN o.c = n.c THEN 'NoOp' ELSE 'Update' END AS action, coalesce(conflict, false) AS conflict FROM o FULL JOIN n ON o.key = n.key")
def reconcile_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    owner = lambda size: F.concat_ws("/", F.lit("shop"), size, F.col("p_partkey").cast("string")).alias("owner")
    stored = part.select(F.col("p_brand").alias("key"), F.col("p_type").alias("content"), owner(F.col("p_size").cast("string")))
    incoming = part.where("p_size = 8").select(F.col("p_brand").alias("key"), F.upper("p_type").alias("content"), owner(F.lit("7")))
    return incremental.reconcile_owners(stored, incoming, "shop/7")
