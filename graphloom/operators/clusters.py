"""Communities, clusters and what lies between them; budgeted layouts; orders of condensed graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators.components import components
from graphloom.operators.traverse import hops, rings
from graphloom.storage import ship_package, written

# Weights of relation kinds in the architecture scope; limits of layouts; kinds that make clusters.
ARCHITECTURE = {"Calls": 4, "Imports": 3, "Contains": 1}
RADIUS, MAX_RADIUS = 2, 5
NODE_BUDGET, EDGE_BUDGET = (150, 2000), (400, 6000)
CLUSTER_KINDS = ("Calls", "Imports", "DependsOnPackage", "BelongsToPackage")


def weighted(edges: DataFrame, weights: dict[str, int] | None = None, production: DataFrame | None = None) -> DataFrame:
    """edges: source, target, kind. u < v, weight: parallel edges add up; kinds without a weight over zero are left out.

    weights None: every kind counts one. production (id): both ends have to be there.
    """
    if weights is None:
        rows = edges.select("source", "target", F.lit(1).cast("long").alias("weight"))
    else:
        table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w)])
        rows = edges.select("source", "target", table[F.col("kind")].cast("long").alias("weight")).where("weight > 0")
    if production is not None:
        for end in ("source", "target"):
            rows = rows.join(production.select(F.col("id").alias(end)), end, "left_semi")
    ends = rows.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), "weight")
    return ends.groupBy("u", "v").agg(F.sum("weight").alias("weight"))


def local_moving(links: DataFrame) -> DataFrame:
    """links: u, v, weight. id, community: nodes move one after the other, the smallest active id first.

    A node joins the label with the largest weight_in * total - degree * volume, the smallest of equals, only if that beats
    staying; its neighbours become active again. The order is the definition, so each connected component is worked on by one
    task; components are the unit of distribution. A component has to fit a worker's memory (about 200 bytes for each link).
    """
    links = written(links, "weighted-links")
    roots = components(links.where("u <> v").select("u", "v"))
    total = links.agg(F.coalesce(F.sum(2 * F.col("weight")), F.lit(0))).first()[0]
    own = links.join(roots.select(F.col("node").alias("u"), "root"), "u", "left").select(F.coalesce("root", "u").alias("root"), "u", "v", "weight")
    parts = max(1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, root = [], None
        for batch in batches:
            for r, u, v, w in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r != root:
                    yield _moved(held, total)
                    held = []
                root = r
                held.append((u, v, w))
        if held:
            yield _moved(held, total)

    ship_package(links.sparkSession)
    return own.repartition(parts, "root").sortWithinPartitions("root").mapInArrow(move, "id string, community string")


def _moved(links: list[tuple[str, str, int]], total: int) -> pa.RecordBatch:
    import heapq

    ids = sorted({x for u, v, _ in links for x in (u, v)})
    at = {x: k for k, x in enumerate(ids)}
    near: list[dict[int, int]] = [{} for _ in ids]
    for u, v, w in links:
        a, b = at[u], at[v]
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    degree = [sum(x.values()) for x in near]
    label, volume = list(range(len(ids))), list(degree)
    queue, waiting = list(range(len(ids))), [True] * len(ids)
    left = max(1, len(ids)) * max(len(links), len(ids), 1)
    while queue and left:
        left -= 1
        node = heapq.heappop(queue)
        waiting[node] = False
        volume[label[node]] -= degree[node]
        inside = {label[node]: 0}
        for other, w in near[node].items():
            inside[label[other]] = inside.get(label[other], 0) + w
        gain = {x: w * total - degree[node] * volume[x] for x, w in inside.items()}
        best = min(gain, key=lambda x: (-gain[x], x))
        if gain[best] > gain[label[node]]:
            label[node] = best
            for other in near[node]:
                if not waiting[other]:
                    waiting[other] = True
                    heapq.heappush(queue, other)
        volume[label[node]] += degree[node]
    first: dict[int, str] = {}
    for k, x in enumerate(ids):
        first.setdefault(label[k], x)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([first[x] for x in label])], names=["id", "community"])


def community_summary(members: DataFrame, edges: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """members: id, community. edges: id, source, target. packages: id, name. Of each community with two members or more:

    members, intra, boundary (counts), cohesion, conductance (to 12 places), boundary_edges, bridges, representatives (five with
    the most inner edges), packages: sorted lists.
    """
    n = members.groupBy("community").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    kept = members.join(n.select("community"), "community", "left_semi")
    a = members.select(F.col("id").alias("source"), F.col("community").alias("a"))
    b = members.select(F.col("id").alias("target"), F.col("community").alias("b"))
    ends = edges.select(F.col("id").alias("edge"), "source", "target").join(a, "source").join(b, "target")
    sides = ends.select("edge", F.explode(F.array(F.struct(F.col("a").alias("community"), F.col("source").alias("id")), F.struct(F.col("b").alias("community"), F.col("target").alias("id")))).alias("s"), (F.col("a") == F.col("b")).alias("inside")).select("edge", "s.*", "inside")
    sides = written(sides, "community-sides")
    counts = sides.groupBy("community").agg(
        F.call_function("div", F.count_if("inside"), F.lit(2)).alias("intra"), F.count_if(~F.col("inside")).alias("boundary"),
        F.array_sort(F.collect_set(F.when(~F.col("inside"), F.col("edge")))).alias("boundary_edges"),
        F.array_sort(F.collect_set(F.when(~F.col("inside"), F.col("id")))).alias("bridges"),
    )
    inner = kept.join(sides.where("inside").groupBy("id").agg(F.count(F.lit(1)).alias("d")), "id", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("d"), "id"))
    top = inner.withColumn("k", rank).where("k <= 5").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("representatives"))
    out = n.join(counts, "community", "left").join(top, "community", "left")
    none = F.array().cast("array<string>")
    if packages is not None:
        named = kept.join(packages, "id").groupBy("community").agg(F.array_sort(F.collect_set("name")).alias("packages"))
        out = out.join(named, "community", "left")
    else:
        out = out.withColumn("packages", none)
    intra, boundary, size = F.coalesce("intra", F.lit(0)), F.coalesce("boundary", F.lit(0)), F.col("members")
    stable = lambda x: F.round(x, 12)
    return out.select(
        "community", "members", intra.alias("intra"), boundary.alias("boundary"),
        F.least(F.lit(1.0), stable(intra / F.greatest(size * (size - 1) / 2.0, F.lit(1.0)))).alias("cohesion"),
        stable(boundary / F.greatest(2 * intra + boundary, F.lit(1))).alias("conductance"),
        F.coalesce("boundary_edges", none).alias("boundary_edges"), F.coalesce("bridges", none).alias("bridges"), "representatives", F.coalesce("packages", none).alias("packages"),
    )


def clusters(graph: PropertyGraph, kinds: tuple[str, ...] = CLUSTER_KINDS) -> DataFrame:
    """id, cluster: connected components of two nodes or more over the edges of some kinds; the smallest id names one."""
    rows = graph.kinds(*kinds).edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    return components(rows).select(F.col("node").alias("id"), F.col("root").alias("cluster"))


def cluster_stats(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members: id, cluster. cluster, n, kinds (sorted), intra, incoming, outgoing, cohesion."""
    a = members.select(F.col("id").alias("source"), F.col("cluster").alias("a"))
    b = members.select(F.col("id").alias("target"), F.col("cluster").alias("b"))
    ends = edges.join(a, "source", "left").join(b, "target", "left").select("kind", "a", "b")
    side = lambda c, what: F.struct(F.col(c).alias("cluster"), F.lit(what).alias("what"))
    inside = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    sides = ends.select("kind", F.explode(F.when(inside, F.array(side("a", "intra"))).otherwise(F.array(side("a", "outgoing"), side("b", "incoming")))).alias("s")).select("kind", "s.*").where("cluster IS NOT NULL")
    counts = sides.groupBy("cluster").agg(*[F.count_if(F.col("what") == x).alias(x) for x in ("intra", "incoming", "outgoing")], F.array_sort(F.collect_set(F.when(F.col("what") == "intra", F.col("kind")))).alias("kinds"))
    n = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    out = n.join(counts, "cluster", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("cluster", "n", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), zero("intra"), zero("incoming"), zero("outgoing"), F.when(pairs > 0, F.least(F.lit(1.0), F.coalesce("intra", F.lit(0)) / pairs)).otherwise(0.0).alias("cohesion"))


def cluster_links(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members: id, cluster. edges: id, source, target, kind. Between two clusters: source, target, n, kinds (kind:n, most first), edge_ids (sorted)."""
    a = members.select(F.col("id").alias("source"), F.col("cluster").alias("a"))
    b = members.select(F.col("id").alias("target"), F.col("cluster").alias("b"))
    ends = edges.join(a, "source").join(b, "target").where("a <> b")
    by_kind = ends.groupBy("a", "b", "kind").agg(F.count(F.lit(1)).alias("n"), F.collect_list("id").alias("ids"))
    every = by_kind.groupBy("a", "b").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind"))).alias("k"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("edge_ids"))
    return every.select(F.col("a").alias("source"), F.col("b").alias("target"), "n", F.transform("k", lambda x: F.concat_ws(":", x["kind"], (-x["m"]).cast("string"))).alias("kinds"), "edge_ids")


def slice_insights(members: DataFrame, edges: DataFrame, tensions: DataFrame) -> DataFrame:
    """members: id, cluster. edges: id, source, target, kind. tensions: id, category. cluster, boundary, conductance, top_kinds (two), tensions (count).

    For top_kinds, rows of one id and kind count once in a cluster, as ids may repeat; boundary and conductance count rows.
    """
    stats = cluster_stats(members, edges)
    a = members.select(F.col("id").alias("source"), F.col("cluster").alias("a"))
    b = members.select(F.col("id").alias("target"), F.col("cluster").alias("b"))
    ends = edges.join(a, "source", "left").join(b, "target", "left")
    touched = ends.select("id", "kind", F.explode(F.array_compact(F.array("a", "b"))).alias("cluster")).distinct().groupBy("cluster", "kind").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "kind"))
    top = touched.withColumn("k", rank).where("k <= 2").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "kind"))), lambda x: x["kind"]).alias("top_kinds"))
    hits = members.join(tensions, "id").groupBy("cluster").agg(F.count(F.lit(1)).alias("tensions"))
    boundary = F.col("incoming") + F.col("outgoing")
    out = stats.join(top, "cluster", "left").join(hits, "cluster", "left")
    return out.select("cluster", boundary.alias("boundary"), (boundary / F.greatest(F.lit(1), 2 * F.col("intra") + boundary)).alias("conductance"), F.coalesce("top_kinds", F.array().cast("array<string>")).alias("top_kinds"), F.coalesce("tensions", F.lit(0)).alias("tensions"))


def key_modules(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members: module, id. edges: id, source, target. module, members, incident (edges, each counted once), score."""
    ends = edges.select(F.col("id").alias("edge"), F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    touched = members.join(ends, "id").groupBy("module").agg(F.count_distinct("edge").alias("incident"))
    n = members.groupBy("module").agg(F.count(F.lit(1)).alias("members"))
    return n.join(touched, "module", "left").select("module", "members", F.coalesce("incident", F.lit(0)).alias("incident"), (F.col("members") + F.coalesce("incident", F.lit(0))).alias("score"))


def budget(asked: int, bounds: tuple[int, int]) -> int:
    """Zero asks for the least; others are held within the bounds."""
    return min(max(asked or bounds[0], bounds[0]), bounds[1])


def layout(graph: PropertyGraph, centre: str | None = None, radius: int = 0, labels: tuple[str, ...] = (), kinds: tuple[str, ...] = (), hide_unresolved: bool = False, max_nodes: int = 0, max_edges: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, label, degree, hop, place, x, y), edges (id, source, target, kind) and one row of counts, within budgets.

    From the centre, up to a radius (0 stands for 2, 5 at most); else from the node with the most edges, and nodes it does not
    reach stand on a ring behind the last. The nearest nodes are kept, of those the ones with the most edges, then by id; edges
    by source, kind and target. The centre is never filtered.
    """
    edges = graph.edges.where(F.col("kind").isin(*kinds)) if kinds else graph.edges
    degree = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    nodes = written(graph.nodes.select("id", "label").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), "layout-nodes")
    root = nodes.where(F.col("id") == centre) if centre else nodes.orderBy(F.desc("degree"), "id").limit(1)
    reached = hops(edges, root.select(F.col("id").alias("root"), "id"), "both", min(radius or RADIUS, MAX_RADIUS) if centre else None).select("id", "hop")
    if not centre:
        reached = written(reached, "reached")
        last = reached.agg(F.coalesce(F.max("hop"), F.lit(-1))).first()[0]
        reached = reached.unionByName(nodes.select("id").join(reached, "id", "left_anti").withColumn("hop", F.lit(last + 1)))
    keep = F.lit(True)
    if labels:
        keep &= F.lower("label").isin(*[x.lower() for x in labels])
    if hide_unresolved:
        keep &= F.col("label") != "Unresolved"
    if centre:
        keep |= F.col("id") == centre
    candidates = written(nodes.join(reached, "id").where(keep), "layout-candidates")
    most = budget(max_nodes, NODE_BUDGET)
    chosen = written(candidates.orderBy("hop", F.desc("degree"), "id").limit(most), "layout-chosen")
    between = edges
    for end in ("source", "target"):
        between = between.join(chosen.select(F.col("id").alias(end)), end, "left_semi")
    between = written(between.select("id", "source", "target", "kind"), "layout-edges")
    limit = budget(max_edges, EDGE_BUDGET)
    counts = candidates.agg(F.count(F.lit(1)).alias("nodes_available")).crossJoin(between.agg(F.count(F.lit(1)).alias("edges_available")))
    counts = counts.select("nodes_available", "edges_available", (F.col("nodes_available") > most).alias("nodes_truncated"), (F.col("edges_available") > limit).alias("edges_truncated"))
    placed = chosen.join(rings(chosen.select("id", "hop")).drop("hop"), "id")
    return placed, between.orderBy("source", "kind", "target", "id").limit(limit), counts


def topological_order(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members: id, component. edges: source, target between ids. position, id: components in topological order, the ready one
    with the smallest member first; members of one by id.

    The order is sequential by definition; it is made on the driver over components, whose number has to be bounded: it is for
    module graphs. `resolve.topological_layers` orders graphs of any size by layers.
    """
    import heapq

    first = members.groupBy("component").agg(F.min("id").alias("first"))
    a = members.select(F.col("id").alias("source"), F.col("component").alias("a"))
    b = members.select(F.col("id").alias("target"), F.col("component").alias("b"))
    after: dict[str, list[str]] = {}
    waits: dict[str, int] = {}
    for r in edges.join(a, "source").join(b, "target").where("a <> b").select("a", "b").distinct().toLocalIterator():
        after.setdefault(r.a, []).append(r.b)
        waits[r.b] = waits.get(r.b, 0) + 1
    names = {r.component: r.first for r in first.toLocalIterator()}
    ready = [(names[c], c) for c in names if not waits.get(c)]
    heapq.heapify(ready)
    order = []
    while ready:
        _, c = heapq.heappop(ready)
        order.append((c, len(order)))
        for d in after.get(c, ()):
            waits[d] -= 1
            if not waits[d]:
                heapq.heappush(ready, (names[d], d))
    spark = members.sparkSession
    kind = members.schema["component"].dataType.simpleString()
    at = spark.createDataFrame(order, f"component {kind}, at long")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(at, "component")
    begin = F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))  # one row for each component
    inner = F.row_number().over(Window.partitionBy("component").orderBy("id"))
    placed = members.withColumn("k", inner).join(sizes.withColumn("begin", F.coalesce(begin, F.lit(0))), "component")
    return placed.select((F.col("begin") + F.col("k") - 1).alias("position"), "id", "component")


def blast_radius(edges: DataFrame, roots: DataFrame, kinds: tuple[str, ...], dependents: bool = True) -> DataFrame:
    """roots: root, id. Everything that depends on the roots (or that they depend on) over some kinds, as far as it goes: root, id, hop."""
    return hops(edges.where(F.col("kind").isin(*kinds)), roots, "in" if dependents else "out", None)


def forest_roots(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """nodes: id, label. parents: id, parent (one each at most). id, root, group: tree:<root> for trees, kind:<label> for single nodes.

    Pointers jump, so the rounds grow with the logarithm of the height; nodes on a circle have the smallest of it as root.
    """
    up = written(nodes.select("id").join(parents, "id", "left").select("id", F.coalesce("parent", "id").alias("at"), F.col("id").alias("least")), "pointers")
    for _ in range(40):
        jump = up.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("least").alias("l"))
        new = written(up.join(jump, "at", "left").select("id", F.coalesce("next", "at").alias("at"), F.least("least", F.coalesce("l", "least")).alias("least")), "pointers")
        if new.join(up, ["id", "at"], "left_anti").isEmpty():
            break
        up = new
    top = up.join(up.select(F.col("id").alias("at"), F.col("at").alias("end")), "at", "left")
    root = F.when(F.coalesce(F.col("end") == F.col("at"), F.lit(True)), F.col("at")).otherwise(F.col("least"))
    own = top.select("id", root.alias("root"))
    sizes = own.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    labels = nodes.select("id", "label")
    group = F.when(F.col("n") > 1, F.concat(F.lit("tree:"), "root")).otherwise(F.concat(F.lit("kind:"), "label"))
    return own.join(sizes, "root").join(labels, "id").select("id", "root", group.alias("group"))


def member_expansion(seeds: DataFrame, edges: DataFrame, barred: DataFrame) -> DataFrame:
    """seeds: module, id. What each module reaches along the edges without entering a barred id (other files): module, id."""
    steps = edges.select("source", "target").distinct().join(barred.select(F.col("id").alias("target")), "target", "left_anti")
    steps = written(steps, "arcs")
    at = seen = written(seeds.select("module", "id").distinct(), "members")
    while not at.isEmpty():
        found = at.join(steps, at["id"] == steps["source"]).select("module", F.col("target").alias("id")).distinct()
        at = written(found.join(seen, ["module", "id"], "left_anti"), "members")
        seen = written(seen.unionByName(at), "members")
    return seen


def boundary_bridges(members: DataFrame, edges: DataFrame, score: DataFrame) -> DataFrame:
    """members: id, cluster. score: id, score. Nodes with an edge to another cluster, and their score."""
    a = members.select(F.col("id").alias("source"), F.col("cluster").alias("a"))
    b = members.select(F.col("id").alias("target"), F.col("cluster").alias("b"))
    ends = edges.join(a, "source").join(b, "target").where("a <> b")
    return ends.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(score, "id")


def owner_fragments(nodes: DataFrame, edges: DataFrame, owners: DataFrame) -> DataFrame:
    """nodes: id. edges: id, source. owners: id, owner (several for shared nodes). kind (node, edge), id, fragment: the owner, or
    "shared" for what has several or none. An edge belongs to its source."""
    own = owners.groupBy("id").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("owner"))
    fragment = F.when(F.col("n") == 1, F.col("owner")).otherwise("shared")
    n = nodes.select("id").join(own, "id", "left").select(F.lit("node").alias("kind"), "id", fragment.alias("fragment"))
    e = edges.select("id", "source").join(own.withColumnRenamed("id", "source"), "source", "left").select(F.lit("edge").alias("kind"), "id", fragment.alias("fragment"))
    return n.unionByName(e)


def node_label_priority(degree: Column, selected: Column, entry: Column, label: Column) -> Column:
    """Which nodes are labelled first: degree, ten thousand if selected, two thousand for entry points, and a bonus by label."""
    bonus = F.when(label == "Module", 500).when(label == "Package", 400).when(label == "Artifact", 100).otherwise(0)
    return degree + F.when(selected, 10_000).otherwise(0) + F.when(entry, 2_000).otherwise(0) + bonus
