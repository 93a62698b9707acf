"""Iterative traversals. Each step joins a frontier with the edges; the visited nodes are a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.storage import written

MAX_DEPTH = 5


def arcs(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Distinct steps u -> v along the edges (out), against them (in) or either way (both)."""
    out = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    back = edges.select(F.col("target").alias("u"), F.col("source").alias("v"))
    if direction not in ("in", "out", "both"):
        raise ValueError(f"direction is in, out or both, not {direction}")
    steps = out if direction == "out" else back if direction == "in" else out.unionByName(back)
    return steps.distinct()


def _either_way(edges: DataFrame) -> DataFrame:
    """Steps u -> v along and against the edges, as often as there are edges."""
    return edges.select(F.explode(F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v")), F.struct(F.col("target").alias("u"), F.col("source").alias("v")))).alias("x")).select("x.u", "x.v")


def hops(edges: DataFrame, roots: DataFrame, direction: str = "both", depth: int | None = 2) -> DataFrame:
    """roots: columns root, id. For each root: root, id, hop (the least), up to `depth` (None: as far as it goes)."""
    steps = written(arcs(edges, direction), "arcs")
    seen = written(roots.select("root", "id").distinct().withColumn("hop", F.lit(0)), "hops")
    frontier, hop = seen, 0
    while depth is None or hop < depth:
        hop += 1
        found = frontier.join(steps, frontier["id"] == steps["u"]).select("root", F.col("v").alias("id")).distinct()
        new = written(found.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        if new.isEmpty():
            break
        frontier = new
        seen = written(seen.unionByName(new), "hops") if hop % 4 == 0 else seen.unionByName(new)
    return seen


def trace(graph: PropertyGraph, root: str, direction: str = "both", depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within `depth` hops (0 stands for 2, 5 at most) with their hop, and the edges between them."""
    depth = min(depth or 2, MAX_DEPTH)
    start = graph.nodes.where(F.col("id") == root).select(F.col("id").alias("root"), "id")
    reached = hops(graph.edges, start, direction, depth).select("id", "hop")
    nodes = graph.nodes.join(reached, "id").select("id", "label", "name", "hop")
    ends = reached.select("id")
    edges = graph.edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi")
    return nodes, edges.join(ends.withColumnRenamed("id", "target"), "target", "left_semi").select(*graph.edges.columns)


def impact(graph: PropertyGraph, root: str, depth: int = 2) -> DataFrame:
    """What depends on the root: the nodes of an inbound trace."""
    return trace(graph, root, "in", depth)[0]


def affected(graph: PropertyGraph, targets: DataFrame, depth: int = 2) -> DataFrame:
    """targets: column target. What each target reaches against the edges: target, id, hop; a target that is no node has nulls."""
    start = targets.join(graph.nodes.select("id"), F.col("target") == F.col("id")).select(F.col("target").alias("root"), "id")
    found = hops(graph.edges, start, "in", depth).withColumnRenamed("root", "target")
    return targets.join(found, "target", "left").select("target", "id", "hop")


def shortest_path(graph: PropertyGraph, source: str, target: str, longest: int = 32) -> DataFrame:
    """The hops of a shortest path, edges taken either way: hop, source, target, edge_id; no rows if there is none.

    Of several, the one with the smallest sequence of ids; of parallel edges, the smallest id. A level that has a neighbour of the
    target is the last; it is not followed any more.
    """
    steps = written(_either_way(graph.edges), "arcs")
    near = written(steps.where(F.col("v") == target).select(F.col("u").alias("id")).distinct(), "near")
    known = graph.nodes.where(F.col("id") == source).select("id", F.array("id").alias("trail"))
    frontier = seen = written(known, "trails")
    for _ in range(longest):
        if not frontier.where(F.col("id") == target).isEmpty():
            break
        hit = written(frontier.join(near, "id", "left_semi").agg(F.min("trail").alias("trail")).where("trail IS NOT NULL"), "trails")
        if not hit.isEmpty():
            frontier = hit.select(F.lit(target).alias("id"), F.array_append("trail", F.lit(target)).alias("trail"))
            break
        found = frontier.join(steps, frontier["id"] == steps["u"]).select(F.col("v").alias("id"), F.array_append("trail", F.col("v")).alias("trail"))
        found = found.groupBy("id").agg(F.min("trail").alias("trail"))
        frontier = written(found.join(seen.select("id"), "id", "left_anti"), "trails")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    trail = written(frontier.where(F.col("id") == target), "trail")
    pairs = trail.where("size(trail) > 1").select(
        F.posexplode(F.expr("transform(sequence(1, size(trail) - 1), i -> struct(trail[i - 1] AS a, trail[i] AS b))")).alias("pos", "x")
    )
    pairs = pairs.select((F.col("pos") + 1).alias("hop"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    ends = graph.edges.select("id", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"))
    edge = pairs.join(ends, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")))
    return edge.groupBy("hop", "a", "b").agg(F.min("id").alias("edge_id")).select("hop", F.col("a").alias("source"), F.col("b").alias("target"), "edge_id")


def closure(edges: DataFrame, direction: str = "out") -> DataFrame:
    """All pairs (root, id) with a path of one edge or more, and the least number of hops; written each round."""
    steps = written(arcs(edges, direction), "arcs")
    seen = frontier = written(steps.select(F.col("u").alias("root"), F.col("v").alias("id"), F.lit(1).alias("hop")), "closure")
    hop = 1
    while not frontier.isEmpty():
        hop += 1
        found = frontier.join(steps, frontier["id"] == steps["u"]).select("root", F.col("v").alias("id")).distinct()
        frontier = written(found.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("hop", F.lit(hop)), "closure")
        seen = seen.unionByName(frontier)
    return seen


def strong_components(edges: DataFrame) -> DataFrame:
    """Nodes on cycles: id, component (its smallest member), members.

    Round by round: nodes without a way in or out are trimmed; each other node takes the colour of the smallest node that reaches
    it; what reaches a colour's own node within the colour is a component with it, and goes. All steps are joins on the edges,
    so no set of reachable pairs is made.
    """
    every = edges.select(F.col("source").alias("u"), F.col("target").alias("v")).distinct()
    loops = every.where("u = v").select(F.col("u").alias("id"))
    left = written(every.where("u <> v"), "arcs")
    found = None
    while True:
        n = left.count()
        while n:
            into, out = left.select(F.col("v").alias("u")).distinct(), left.select(F.col("u").alias("v")).distinct()
            left = written(left.join(into, "u", "left_semi").join(out, "v", "left_semi").select("u", "v"), "arcs")
            n, before = left.count(), n
            if n == before:
                break
        if not n:
            break
        colours = written(left.select(F.col("u").alias("id")).distinct().withColumn("colour", F.col("id")), "colours")
        while True:
            seen = left.join(colours, left["u"] == colours["id"]).groupBy("v").agg(F.min("colour").alias("near"))
            new = written(colours.join(seen, colours["id"] == seen["v"], "left").select("id", F.least("colour", F.coalesce("near", "colour")).alias("colour"), (F.col("near") < F.col("colour")).alias("moved")), "colours")
            colours = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        ends = left.join(colours.select(F.col("id").alias("u"), F.col("colour").alias("a")), "u").join(colours.select(F.col("id").alias("v"), F.col("colour").alias("b")), "v")
        inside = written(ends.where("a = b").select("u", "v", F.col("a").alias("colour")), "arcs-of-a-colour")
        at = members = written(colours.where("id = colour"), "members")
        while not at.isEmpty():
            back = at.join(inside.select("u", F.col("v").alias("id"), F.col("colour").alias("c")), "id").where("c = colour").select(F.col("u").alias("id"), "colour").distinct()
            at = written(back.join(members, ["id", "colour"], "left_anti"), "members")
            members = members.unionByName(at)
        members = written(members, "components")
        found = members if found is None else found.unionByName(members)
        gone = members.select("id")
        left = written(left.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v"), "arcs")
    single = loops.select("id", F.col("id").alias("colour"))
    if found is None:
        own = single
    else:
        several = found.join(found.groupBy("colour").count().where("count > 1").select("colour"), "colour", "left_semi").select("id", "colour")
        own = several.unionByName(single.join(several, "id", "left_anti"))
    sizes = own.groupBy("colour").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("members"))
    return own.join(sizes, "colour").select("id", "component", "members")


def untargeted(nodes: DataFrame, edges: DataFrame, ignored: tuple[str, ...] = ("Contains",)) -> DataFrame:
    """nodes that no edge points to, but for edges of the ignored kinds."""
    targets = edges.where(~F.col("kind").isin(*ignored)).select(F.col("target").alias("id")).distinct()
    return nodes.join(targets, "id", "left_anti")


def climb(nodes: DataFrame, edges: DataFrame, label: str, longest: int = 8) -> DataFrame:
    """For each node, the nearest node of `label` up the edges (the smallest id of several): id, owner, hop."""
    steps = written(edges.select(F.col("source").alias("u"), F.col("target").alias("v")).distinct(), "arcs")
    tops = nodes.where(F.col("label") == label).select("id")
    at = nodes.select(F.col("id").alias("root"), "id").withColumn("hop", F.lit(0))
    owned = written(at.join(tops, "id", "left_semi").select("root", F.col("id").alias("owner"), "hop"), "owned")
    for hop in range(1, longest + 1):
        up = at.join(steps, at["id"] == steps["u"]).select("root", F.col("v").alias("id"))
        at = written(up.join(owned.select("root"), "root", "left_anti").distinct().withColumn("hop", F.lit(hop)), "climb")
        if at.isEmpty():
            break
        owned = owned.unionByName(at.join(tops, "id", "left_semi").groupBy("root", "hop").agg(F.min("id").alias("owner")).select("root", "owner", "hop"))
    return owned.withColumnRenamed("root", "id")


def rings(reached: DataFrame, radius: float = 120.0) -> DataFrame:
    """reached: id, hop. Radial positions: hop, its place by id, x and y."""
    ring = Window.partitionBy("hop")
    place = F.row_number().over(ring.orderBy("id")) - 1
    angle = 2 * F.lit(3.141592653589793) * place / F.count(F.lit(1)).over(ring)
    far = F.col("hop") * radius
    return reached.select("id", "hop", place.alias("place"), (far * F.cos(angle)).alias("x"), (far * F.sin(angle)).alias("y"))
