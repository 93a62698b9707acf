"""Retrieval over chunks and nodes: search documents, enrichment, hybrid ranking with filters, class profiles, index upkeep."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import glob_pattern
from graphloom.functions.text import identifier_tokens
from graphloom.graph import PropertyGraph
from graphloom.operators.relational import overlap_join, snapshot_diff
from graphloom.operators.search import HYBRID, dot, semantic_score, weighted_top
from graphloom.operators.traverse import hops
from graphloom.storage import written

PREFETCH, NEIGHBOURS, CONTEXT = 200, 12, 12


def search_documents(nodes: DataFrame) -> DataFrame:
    """nodes: id, label, name, doc, path. id, kind (Symbol, Documentation, Path, Fact), text of what full-text search sees."""
    kind = F.when(F.col("label") == "Symbol", "Symbol").when(F.col("label").isin("Documentation", "Rationale"), "Documentation").when(F.col("label").isin("Artifact", "Module"), "Path").when(F.col("label").isin("Config", "EnvVar", "Command", "Container", "Package"), "Fact")
    text = F.when(kind == "Path", F.coalesce("path", "name")).when(F.col("label") == "Symbol", F.concat_ws(" ", "name", "doc")).when(kind == "Documentation", F.coalesce("doc", "name")).otherwise(F.concat_ws(" ", "label", "name"))
    return nodes.select("id", kind.alias("kind"), text.alias("text")).where("kind IS NOT NULL")


def incremental_records(stored: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """stored: id, digest, text. documents: id, text. The records after the update, the same as built anew, and id, action of each."""
    fresh = documents.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")
    change = snapshot_diff(stored, fresh, "id", "digest")
    action = F.when(F.col("change") == "added", "insert").when(F.col("change") == "changed", "update").when(F.col("change") == "removed", "delete").otherwise("reuse")
    kept = stored.join(change.where("change = 'same'").select("id"), "id", "left_semi").select("id", "digest", "text")
    new = fresh.join(change.where("change IN ('added', 'changed')").select("id"), "id", "left_semi")
    return kept.unionByName(new), change.select("id", action.alias("action"))


def node_documents(graph: PropertyGraph, most: int = CONTEXT) -> DataFrame:
    """id, text: a node's label and name, then up to `most` sorted Kind:neighbour references."""
    near = lambda a, b: graph.edges.select(F.col(a).alias("id"), "kind", F.col(b).alias("other"))
    names = graph.nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    refs = near("source", "target").unionByName(near("target", "source")).join(names, "other").select("id", F.concat_ws(":", "kind", "other_name").alias("ref")).distinct()
    # only the first ones of each node are gathered, so that hubs stay small
    rank = F.row_number().over(Window.partitionBy("id").orderBy("ref"))
    some = refs.withColumn("k", rank).where(F.col("k") <= most).groupBy("id").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    return graph.nodes.join(some, "id", "left").select("id", F.concat_ws(" ", "label", "name", F.array_join("refs", " ")).alias("text"))


def semantic_nodes(vectors: DataFrame, degree: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """vectors: id, vector (of length one). degree: id, degree. asked: the question's vector. id, score: cosine and degree share; the k best."""
    most = degree.agg(F.max("degree").alias("most"))
    rows = vectors.join(degree, "id", "left").crossJoin(F.broadcast(most))
    score = semantic_score(dot(F.col("vector"), asked), F.coalesce("degree", F.lit(0)), F.coalesce("most", F.lit(0)))
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def semantic_top(vectors: DataFrame, degree: DataFrame, queries: DataFrame, k: int = 10, block: int = 10_000) -> DataFrame:
    """queries: query, vector. As semantic_nodes() for many questions: query, id, score, rank; then id.

    All nodes are scored against a block of questions, one block after the other, as products of matrices.
    """
    most = degree.agg(F.max("degree").alias("most"))
    rows = vectors.join(degree, "id", "left").crossJoin(F.broadcast(most))
    share = semantic_score(F.lit(0.0), F.coalesce("degree", F.lit(0)), F.coalesce("most", F.lit(0)))
    return weighted_top(rows.select("id", "vector", share.alias("extra")), queries, 0.7, False, k, block)


def placed(chunks: DataFrame) -> DataFrame:
    """chunks: path, first, last (lines), more. They with place: chunks of one place have the same symbols, tags and neighbours."""
    return chunks.withColumn("place", F.to_json(F.struct("path", "first", "last")))


def enriched(chunks: DataFrame, symbols: DataFrame, edges: DataFrame, modules: DataFrame, packages: DataFrame, layers: DataFrame, tags: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """chunks: id, path, first, last (lines). The rest as enriched_places(), which tells what each chunk gets."""
    rows = placed(chunks).select("id", "path", "place")
    places = enriched_places(chunks, symbols, edges, modules, packages, layers, tags, most)
    return rows.join(places.drop("path"), "place").drop("place")


def enriched_places(chunks: DataFrame, symbols: DataFrame, edges: DataFrame, modules: DataFrame, packages: DataFrame, layers: DataFrame, tags: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """chunks: path, first, last (lines). symbols: symbol, path, first, last. modules, layers: path, module / layer. packages: module, package.
    tags: id (of a symbol), tag. edges: source, target, kind.

    Each place of chunks with symbols (that share a line), module, package (of the module), layer, tags and up to `most`
    neighbours (kind, direction, id) of its symbols: sorted lists. Chunks of one place have them from one row, so pairs of
    chunks and symbols are never laid out.
    """
    base = placed(chunks).select("place", "path", F.col("first").alias("a"), F.col("last").alias("b")).distinct()
    inside = written(overlap_join(base, symbols, "path", ("a", "b"), ("first", "last")).select("place", "symbol").distinct(), "place-symbols")
    names = inside.groupBy("place").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    tagged = inside.join(tags.withColumnRenamed("id", "symbol"), "symbol").groupBy("place").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    # ends of edges beyond the first and the last symbol are none of them, and are not shuffled
    ends = inside.agg(F.min("symbol").alias("first"), F.max("symbol").alias("last")).first()
    way = lambda a, b, d: edges.where(F.col(a).between(ends["first"], ends["last"])).select(F.col(a).alias("symbol"), F.struct("kind", F.lit(d).alias("direction"), F.col(b).alias("id")).alias("n"))
    both = inside.join(way("source", "target", "out").unionByName(way("target", "source", "in")), "symbol").select("place", "n")
    # equal neighbours have one rank, so each task keeps its first ones before anything is shuffled by place
    rank = F.dense_rank().over(Window.partitionBy("place").orderBy("n"))
    near = both.withColumn("k", rank).where(F.col("k") <= most).groupBy("place").agg(F.array_sort(F.collect_set("n")).alias("neighbours"))
    out = base.join(names, "place", "left").join(tagged, "place", "left").join(near, "place", "left")
    out = out.join(modules.select("path", "module"), "path", "left").join(packages.select("module", "package"), "module", "left").join(layers.select("path", "layer"), "path", "left")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("place", "path", none("symbols"), "module", "package", "layer", none("tags"), none("neighbours"))


@dataclass(frozen=True)
class Filters:
    """What a chunk has to satisfy; None and empty ask for nothing."""

    path: str | None = None
    module: str | None = None
    package: str | None = None
    layer: str | None = None
    node: str | None = None
    all_tags: tuple[str, ...] = ()
    any_tags: tuple[str, ...] = ()

    def condition(self, by_node: bool = True) -> Column:
        """All of them together; a broken glob is an error."""
        parts = [F.lit(True)]
        if self.path is not None:
            parts.append(F.col("path").rlike(glob_pattern(self.path)))
        parts += [F.col(c).eqNullSafe(F.lit(v)) for c, v in (("module", self.module), ("package", self.package), ("layer", self.layer)) if v is not None]
        if self.node is not None and by_node:
            parts.append(F.array_contains("symbols", self.node))
        parts += [F.array_contains("tags", t) for t in self.all_tags]
        if self.any_tags:
            parts.append(F.arrays_overlap("tags", F.array(*map(F.lit, self.any_tags))))
        return reduce(lambda a, b: a & b, parts)


@dataclass(frozen=True)
class Expansion:
    """How far a question goes from its node; no hops is none."""

    most_hops: int = 0
    kinds: tuple[str, ...] = ()
    direction: str = "both"
    weights: dict[str, float] = field(default_factory=lambda: dict(HYBRID))


def hybrid_rank(chunks: DataFrame, edges: DataFrame, filters: Filters = Filters(), expansion: Expansion = Expansion(), offset: int = 0, limit: int = 10, prefetch: int | None = None, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """chunks: enriched ones with vector and lexical scores. Ranked rows (id, score and its parts, total_matched), and warnings.

    With places (as of enriched_places()) chunks need only id, place and the scores: filters and distances are found once a place.

    Filters come first; `prefetch` keeps the best by vector before them, as some indexes do. With an expansion, chunks without a
    symbol within reach of filters.node are left out, and the nearest one says how near the chunk is.
    """
    rows = chunks.orderBy(F.desc("vector"), "id").limit(prefetch) if prefetch else chunks
    reach = expansion.most_hops > 0 and filters.node is not None
    key, facts = ("id", rows) if places is None else ("place", places)
    facts = facts.where(filters.condition(by_node=not reach))
    if reach:
        own = edges.where(F.col("kind").isin(*expansion.kinds)) if expansion.kinds else edges
        start = edges.sparkSession.range(1).select(F.lit(filters.node).alias("root"), F.lit(filters.node).alias("id"))
        near = hops(own, start, expansion.direction, expansion.most_hops).select(F.col("id").alias("symbol"), "hop")
        nearest = facts.select(key, F.explode("symbols").alias("symbol")).join(near, "symbol").groupBy(key).agg(F.min("hop").alias("hop"))
        facts = facts.join(nearest, key)
    else:
        facts = facts.withColumn("hop", F.lit(None).cast("int"))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    has = F.array_contains("symbols", filters.node) if filters.node is not None else F.lit(False)
    n = F.size("neighbours")
    wanted = F.size(F.filter("neighbours", lambda x: x["kind"].isin(*expansion.kinds))) / n if expansion.kinds else F.lit(1.0)
    parts = {
        "vector": clamp(F.col("vector").cast("double")),
        "lexical": clamp(F.coalesce(F.col("lexical").cast("double"), F.lit(0.0))),
        "containment": F.when(has, 1.0).otherwise(F.least(F.size("symbols") / 4.0, F.lit(1.0))),
        "distance": F.coalesce(1.0 / (1.0 + F.col("hop")), F.lit(0.0)),
        "relation": F.when(n == 0, 0.0).otherwise(wanted),
    }
    if places is None:
        scored = facts.select("id", *[v.alias(k) for k, v in parts.items()])
    else:
        of_place, of_chunk = ("containment", "distance", "relation"), ("vector", "lexical")
        facts = facts.select("place", *[parts[k].alias(k) for k in of_place])
        scored = rows.select("id", "place", *[parts[k].alias(k) for k in of_chunk]).join(facts, "place").select("id", *parts)
    total = reduce(lambda a, b: a + b, [F.lit(expansion.weights[k]) * F.col(k) for k in parts])
    scored = written(scored.withColumn("score", total), "ranked")
    matched = scored.agg(F.count(F.lit(1)).alias("total_matched"))
    page = scored.orderBy(F.desc(F.round("score", 9)), "id").offset(offset).limit(limit).crossJoin(F.broadcast(matched))
    empty = filters == Filters()
    broad = matched.select(F.when(F.lit(empty and not reach), "over-broad").alias("warning"))
    contradictory = matched.select(F.when((F.col("total_matched") == 0) & F.lit(not empty or reach), "unsatisfiable").alias("warning"))
    unknown = matched.limit(0).select(F.lit("").alias("warning"))
    if filters.node is not None:
        there = edges.where((F.col("source") == filters.node) | (F.col("target") == filters.node)).limit(1).agg(F.count(F.lit(1)).alias("n"))
        unknown = there.where("n = 0").select(F.lit("unknown node").alias("warning"))
    return page, broad.unionByName(contradictory).unionByName(unknown).where("warning IS NOT NULL")


def class_profiles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id, label, name. edges: source, target, kind. Of each Class: methods, fields, bases, imports, calls, packages: sorted names."""
    names = nodes.select(F.col("id").alias("target"), F.col("label").alias("to"), F.col("name").alias("to_name"))
    out = edges.join(nodes.where("label = 'Class'").select(F.col("id").alias("source")), "source", "left_semi").join(names, "target")
    kind, to = F.col("kind"), F.col("to")
    parts = {
        "methods": (kind == "Contains") & (to == "Method"), "fields": (kind == "Contains") & (to == "Field"), "bases": kind == "Inherits",
        "imports": kind == "Imports", "calls": kind == "Calls", "packages": kind == "DependsOnPackage",
    }
    gathered = out.groupBy(F.col("source").alias("id")).agg(*[F.array_sort(F.collect_set(F.when(c, F.col("to_name")))).alias(k) for k, c in parts.items()])
    base = nodes.where("label = 'Class'").select("id", "name").join(gathered, "id", "left")
    return base.select("id", "name", *[F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in parts])


def class_filter(profiles: DataFrame, question: str, roles: dict[str, tuple[str, ...]]) -> DataFrame:
    """id, lexical, role, graph, shape, total over 0: how well classes fit a question, part by part.

    lexical: words of the question among the words of a class; role: those that are words of a role which the class has by its
    name; graph: (imports + calls + packages) / 10; shape: (methods + fields + bases) / 10.
    """
    asked = [w for w in dict.fromkeys(question.lower().split()) if w]
    lists = ("methods", "fields", "bases", "imports", "calls", "packages")
    words = F.array_distinct(identifier_tokens(F.concat_ws(" ", "name", *[F.array_join(x, " ") for x in lists])))
    count = lambda items: F.size(F.filter(F.array(*map(F.lit, items)), lambda w: F.array_contains("words", w))) if items else F.lit(0)
    rows = profiles.withColumn("words", words)
    own = F.lower("name")
    hits = [F.when(reduce(lambda a, b: a | b, [own.contains(w) for w in (role, *ws)]), F.lit(sum(w in (role, *ws) for w in asked))).otherwise(0) for role, ws in roles.items()]
    role = reduce(lambda a, b: a + b, hits) if hits else F.lit(0)
    size = lambda names: reduce(lambda a, b: a + b, [F.size(x) for x in names]) / 10.0
    scored = rows.select("id", count(asked).cast("double").alias("lexical"), role.cast("double").alias("role"), size(lists[3:]).alias("graph"), size(lists[:3]).alias("shape"))
    match = F.col("lexical") + F.col("role")
    return scored.withColumn("total", F.when(match > 0, match + F.col("graph") + F.col("shape")).otherwise(0.0)).where("total > 0")


def index_state(stored_digest: str | None, digest: str) -> str:
    """missing, fresh or stale."""
    return "missing" if stored_digest is None else "fresh" if stored_digest == digest else "stale"


def graph_digest(graph: PropertyGraph) -> DataFrame:
    """One row, digest: equal graphs have equal ones, whatever the order of rows is."""
    total = lambda df: df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    n, e = total(graph.nodes.select("id", "label", "name")), total(graph.edges.select("id", "source", "target", "kind"))
    return n.select(F.col("s").alias("s1"), F.col("n").alias("n1")).crossJoin(e).select(F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("s1", "n1", "s", "n"))), 256).alias("digest"))


def index_plan(stored: DataFrame, wanted: DataFrame, profile_changed: bool = False) -> DataFrame:
    """id, action (Reuse, Insert, Update, Delete), reason; everything is inserted anew if the embedding's profile changed."""
    change = snapshot_diff(stored, wanted, "id", "digest")
    what = F.col("change")
    action = F.when(what == "removed", "Delete").when(F.lit(profile_changed), "Insert").when(what == "added", "Insert").when(what == "changed", "Update").otherwise("Reuse")
    reason = F.when(what == "removed", "no longer there").when(F.lit(profile_changed), "profile changed").when(what == "added", "new").when(what == "changed", "content changed").otherwise("same content")
    return change.select("id", action.alias("action"), reason.alias("reason"))


#: The fields of an embedding's profile, and those whose change leaves stored vectors as they are.
PROFILE = ("provider", "model", "dimensions", "normalised", "document_prompt", "query_prompt", "max_tokens", "version")
QUERY_ONLY = ("query_prompt",)


def profile_difference(stored: dict, wanted: dict) -> list[str]:
    """The fields that force a rebuild, in order."""
    return [f for f in PROFILE if f not in QUERY_ONLY and stored.get(f) != wanted.get(f)]


def plan_divergence(planned: DataFrame, performed: DataFrame) -> DataFrame:
    """planned, performed: id, action. id, planned, performed where they differ."""
    both = planned.select("id", F.col("action").alias("planned")).join(performed.select("id", F.col("action").alias("performed")), "id", "full_outer")
    return both.where(~F.col("planned").eqNullSafe(F.col("performed")))
