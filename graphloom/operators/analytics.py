"""Degrees, summaries, PageRank, betweenness and communities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.storage import apart, written


def degrees(graph: PropertyGraph, dangling: bool = False) -> DataFrame:
    """id, in_degree, out_degree of each node; with dangling, of endpoints without a node row too."""
    ends = graph.edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )).alias("x")).select("x.*")
    counts = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    joined = graph.nodes.select("id").join(counts, "id", "full_outer" if dangling else "left")
    return joined.select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree")))


def schema_summary(graph: PropertyGraph) -> DataFrame:
    """Counts by label, by kind and by pattern: what, name, n. An end without a node is Unknown."""
    labels = graph.nodes.select("id", "label")
    ends = graph.edges.join(labels.select(F.col("id").alias("source"), F.col("label").alias("a")), "source", "left")
    ends = ends.join(labels.select(F.col("id").alias("target"), F.col("label").alias("b")), "target", "left")
    unknown = lambda c: F.coalesce(c, F.lit("Unknown"))
    pattern = F.concat(F.lit("("), unknown("a"), F.lit(")-["), F.col("kind"), F.lit("]->("), unknown("b"), F.lit(")"))
    # kinds and patterns come from one pass over the joined edges
    grouped = ends.select("kind", pattern.alias("pattern")).groupingSets([["kind"], ["pattern"]], "kind", "pattern")
    by_edge = grouped.agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("kind").isNotNull(), "kind").otherwise("pattern").alias("what"), F.coalesce("kind", "pattern").alias("name"), "n"
    )
    by_label = graph.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("what"), F.col("label").alias("name"), "n")
    return by_label.unionByName(by_edge)


def dependency_matrix(owners: DataFrame, edges: DataFrame) -> DataFrame:
    """owners: id, owner. Counts of edges between different owners: source_owner, target_owner, n."""
    a = owners.select(F.col("id").alias("source"), F.col("owner").alias("source_owner"))
    b = owners.select(F.col("id").alias("target"), F.col("owner").alias("target_owner"))
    joined = edges.join(a, "source").join(b, "target").where("source_owner <> target_owner")
    return joined.groupBy("source_owner", "target_owner").agg(F.count(F.lit(1)).alias("n"))


def pagerank(graph: PropertyGraph, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """id, rank after a fixed number of rounds from a uniform start.

    Repeated targets of a source count once. What nodes without edges hold is not passed on, so ranks need not add up to 1.
    """
    n = graph.nodes.count()
    nodes = graph.nodes.select("id")
    links = graph.edges.select("source", "target").distinct().join(nodes.withColumnRenamed("id", "source"), "source", "left_semi")
    out = links.groupBy("source").agg(F.count(F.lit(1)).alias("n_out"))
    links = written(links.join(out, "source"), "links")
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    base = F.lit((1 - damping) / max(n, 1))
    for k in range(rounds):
        shares = links.join(ranks, links["source"] == ranks["id"]).groupBy("target").agg(F.sum(F.col("rank") / F.col("n_out")).alias("share"))
        ranks = nodes.join(shares, nodes["id"] == shares["target"], "left").select("id", (base + damping * F.coalesce("share", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            ranks = written(ranks, "ranks")
    return ranks


def betweenness(graph: PropertyGraph, exact_up_to: int = 128, samples: int = 32) -> DataFrame:
    """id, score: directed, unnormalised, endpoints not counted.

    All sources up to `exact_up_to` nodes, else `samples` evenly spaced ones scaled up. Path counts go forward and
    dependencies backward level by level, all sources together, as joins with the written edges; no size is refused.
    """
    ordered = written(graph.nodes.select("id").orderBy("id").withColumn("at", F.monotonically_increasing_id()), "ordered-nodes")
    # the place of a row is its task's first place and its place there
    sizes = sorted(tuple(r) for r in ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1))).collect())
    n = sum(size for _, size in sizes)
    places = range(n) if n <= exact_up_to else [k * n // samples for k in range(samples)]
    chosen, first = [], 0
    for part, size in sizes:
        chosen += [(part << 33) + p - first for p in places if first <= p < first + size]
        first += size
    nodes = ordered.select("id")
    edges = graph.edges.where("source <> target").select("source", "target").distinct()
    for end in ("source", "target"):
        edges = edges.join(nodes.withColumnRenamed("id", end), end, "left_semi")
    edges = written(edges.select("source", "target"), "links")
    now = written(ordered.where(F.col("at").isin(chosen)).select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")), "paths")
    levels, seen = [], now.select("s", "id")
    while not now.isEmpty():
        levels.append(now)
        if len(levels) > 1:
            seen = seen.unionByName(now.select("s", "id"))
        if len(levels) % 10 == 0:  # so that plans stay short on long chains
            seen = written(seen, "seen")
        after = now.join(edges, now["id"] == edges["source"]).groupBy("s", F.col("target").alias("id")).agg(F.sum("paths").alias("paths"))
        now = written(after.join(seen, ["s", "id"], "left_anti"), "paths")
    # what is left of a level: of each source's node there, its paths and what later nodes depend on it
    parts, below = [], None
    for level in reversed(levels[1:]):
        if below is None:
            mine = level.withColumn("score", F.lit(0.0))
        else:
            share = below.join(edges, below["id"] == edges["target"]).groupBy("s", F.col("source").alias("id")).agg(F.sum((1 + F.col("score")) / F.col("paths")).alias("share"))
            mine = level.join(share, ["s", "id"], "left").select("s", "id", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("score"))
        below = written(mine, "dependencies")
        parts.append(below.select("id", "score"))
        if len(parts) == 10:
            parts = [written(reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("score").alias("score")), "scores")]
    if not parts:
        return nodes.withColumn("score", F.lit(0.0))
    total = reduce(DataFrame.unionByName, parts).groupBy("id").agg((F.sum("score") * (n / len(chosen))).alias("score"))
    return nodes.join(total, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """edges: u, v, weight (either way). Communities by synchronous label propagation with damping: id, community.

    A node joins the label with the most weight around it, the smallest of equals, only if that beats staying; even and odd
    rounds let nodes with even and odd hashes move, which stops two labels from swapping for ever.
    """
    both = edges.where("u <> v").select("u", "v", "weight").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    both = written(both.groupBy("u", "v").agg(F.sum("weight").alias("weight")), "weights")
    labels = written(both.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id")), "labels")
    quiet = 0
    for k in range(rounds):
        near = both.join(apart(labels), both["v"] == labels["id"]).groupBy("u", "community").agg(F.sum("weight").alias("w"))
        best = near.groupBy("u").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("best"))
        own = near.join(apart(labels.select(F.col("id").alias("u"), F.col("community").alias("own"))), "u").where("community = own").select("u", F.col("w").alias("own_w"))
        move = labels.join(apart(best.withColumnRenamed("u", "id")), "id").join(apart(own.withColumnRenamed("u", "id")), "id", "left")
        may = (F.pmod(F.xxhash64("id"), F.lit(2)) == k % 2) & (-F.col("best.w") > F.coalesce("own_w", F.lit(0)))
        new = written(move.select("id", F.when(may, F.col("best.community")).otherwise(F.col("community")).alias("community"), may.alias("moved")), "labels")
        quiet = 0 if not new.where("moved").isEmpty() else quiet + 1
        labels = new.drop("moved")
        if quiet == 2:
            break
    return labels


def community_stats(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members: id, community. edges: source, target. Of each community: members, intra, boundary, cohesion, conductance."""
    members = written(members.select("id", "community"), "members")
    a = members.select(F.col("id").alias("source"), F.col("community").alias("a"))
    b = members.select(F.col("id").alias("target"), F.col("community").alias("b"))
    ends = edges.join(a, "source").join(b, "target")
    sides = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("community"), (F.col("a") == F.col("b")).alias("inside"))
    counts = sides.groupBy("community").agg(F.count_if("inside").alias("intra"), F.count_if(~F.col("inside")).alias("boundary"))
    n = members.groupBy("community").agg(F.count(F.lit(1)).alias("members"))
    joined = n.join(counts, "community", "left").select("community", "members", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("intra", "boundary")))
    pairs = F.col("members") * (F.col("members") - 1) / 2.0
    return joined.withColumns({
        "cohesion": F.when(pairs > 0, F.least(F.lit(1.0), F.col("intra") / pairs)).otherwise(0.0),
        "conductance": F.col("boundary") / F.greatest(F.lit(1), 2 * F.col("intra") + F.col("boundary")),
    })
