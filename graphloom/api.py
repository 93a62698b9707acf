"""Tools by name over a property graph: each is called with the graph and keyword parameters and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import analytics, clusters, components, decisions, extract, findings, incremental, planning, quality, relational, retrieval, search, traverse
from graphloom.operators.relational import snapshot_diff
from graphloom.plans import match
from graphloom.store import StoreError, export_bundle, import_bundle, load_graph, save_graph, write_report


def _dead(graph: PropertyGraph, label: str, ignored: str = "Contains") -> DataFrame:
    return traverse.untargeted(graph.nodes.where(F.col("label") == label), graph.edges, (ignored,)).select("id", "name")


def _explain(graph: PropertyGraph, node: str) -> DataFrame:
    near = lambda here, there, name: graph.edges.where(F.col(here) == node).select("kind", F.lit(name).alias("direction"), F.col(there).alias("id"))
    return near("target", "source", "in").unionByName(near("source", "target", "out")).distinct()


def _search(graph: PropertyGraph, text: str, label: str | None = None, limit: int = 10) -> DataFrame:
    """Nodes of a label whose name or id contains the text, the best connected first; 10 unless told, 100 at most."""
    rows = graph.nodes.where(F.lower(F.concat_ws(" ", "name", "id")).contains(text.lower()))
    if label:
        rows = rows.where(F.lower("label") == label.lower())
    found = rows.join(analytics.degrees(graph), "id").select("id", "label", "name", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    return found.orderBy(F.desc("degree"), "label", "name", "id").limit(min(limit or 10, 100))


def _findings(graph: PropertyGraph) -> DataFrame:
    degree = analytics.degrees(graph).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    return findings.health(degree, graph.edges)


def _touched(graph: PropertyGraph, members: DataFrame) -> DataFrame:
    """Edges with an end among the members (id)."""
    rows = graph.edges
    for end in ("source", "target"):
        rows = rows.join(members.select(F.col("id").alias(end)).distinct().withColumn(f"_{end}", F.lit(True)), end, "left")
    return rows.where("_source OR _target").select(*graph.edges.columns)


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "query_graph": lambda graph, query: match.run(graph, query),
    "get_graph_schema": analytics.schema_summary,
    "search_graph": _search,
    "trace_path": lambda graph, root, direction="both", depth=2: traverse.trace(graph, root, direction, depth)[0],
    "impact_analysis": traverse.impact,
    "affected": traverse.affected,
    "path": traverse.shortest_path,
    "explain": _explain,
    "find_dead_code": _dead,
    "get_graph_analytics": analytics.pagerank,
    "get_betweenness": analytics.betweenness,
    "get_components": lambda graph: components.components(graph.edges.select(F.col("source").alias("u"), F.col("target").alias("v"))),
    "get_graph_layout": lambda graph, centre=None, **limits: clusters.layout(graph, centre, **limits)[0],
    "validate_graph": lambda graph: graph.issues(),
    "search_fulltext": lambda graph, queries, limit=10: search.bm25(graph.nodes.select("id", F.col("name").alias("text")), queries, limit),
    "resolve_tag_expression": lambda tags, expression: findings.resolve_tags(tags, expression),
    "get_tag_facets": lambda tags: findings.tag_facets(tags),
    "list_tags": lambda tags: findings.tag_facets(tags).select("tag"),
    "search_tag_prefix": lambda tags, prefix: findings.tag_facets(tags).where(F.col("tag").startswith(prefix)).select("tag"),
    "get_tagged_subgraph": lambda graph, tags, expression: _touched(graph, findings.resolve_tags(tags, expression).withColumnRenamed("entity_id", "id")),
    "detect_changes": relational.snapshot_diff,
    "get_repository_tensions": lambda graph: findings.tensions(_findings(graph)),
    "get_health": lambda graph: _findings(graph),
    "get_architecture": lambda graph: clusters.cluster_links(clusters.clusters(graph), graph.edges),
    "get_clusters": lambda graph, kinds=clusters.CLUSTER_KINDS: clusters.cluster_stats(clusters.clusters(graph, kinds), graph.edges),
    "get_communities": lambda graph, weights=None: clusters.local_moving(clusters.weighted(graph.edges, weights)),
    "get_node_detail": lambda graph, node: _explain(graph, node),
    "get_graph_document": lambda graph: quality.id_sections(graph.nodes),
    "list_documentable_subsystems": lambda graph: quality.id_sections(graph.nodes).select("prefix", "n"),
    "get_subsystem_graph_context": lambda graph, members: _touched(graph, members),
    "search_code": lambda lines, text, limit=None: search.grep(lines, text, limit),
    "ask_question": lambda lines, question: search.best_lines(lines, question),
    "search_semantic": lambda vectors, degree, asked, k=10: retrieval.semantic_nodes(vectors, degree, asked, k),
    "search_code_semantic": lambda chunks, edges, **asked: retrieval.hybrid_rank(chunks, edges, **asked)[0],
    "explain_code_index": lambda stored, wanted: retrieval.index_plan(stored, wanted),
    "explain_env": lambda names, uses, definitions: quality.setting_explanations(names, uses, definitions),
    "read_wiki_structure": lambda documents: extract.headings(documents),
    "read_wiki_contents": lambda documents, path: documents.where(F.col("path") == path),
    "validate_subsystem_document": lambda documents, files: findings.drift(documents, files),
    "get_file_tree": lambda files: planning.file_tree(files),
    "reflect_research": lambda events, now: incremental.lessons(events, now),
    "read_research_lessons": lambda events, now, lesson: incremental.lessons(events, now).where(F.col("lesson") == lesson),
    "save_research_result": lambda stored, new: stored.unionByName(new).dropDuplicates(["id"]),
    "read_research_memory": lambda stored, limit=20: stored.orderBy(F.desc("recorded_at"), "id").limit(limit),
    "list_adrs": lambda records: records.select("id", "title", "status"),
    "get_adr": lambda records, ident: records.where(F.col("id") == ident),
    "create_adr": decisions.created,
    "update_adr": decisions.updated,
    "delete_adr": decisions.deleted,
    "detect_drift": lambda documents, files: findings.drift(documents, files),
    "get_run_metrics": lambda runs: quality.run_metrics(runs),
    "list_tools": lambda spark: spark.createDataFrame([(x,) for x in sorted(TOOLS)], "tool string"),
}


def call(tool: str, *args: Any, **params: Any) -> DataFrame:
    """Call a tool; an unknown name tells the known ones."""
    if tool not in TOOLS:
        raise KeyError(f"no tool {tool}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[tool](*args, **params)


def main(arguments: list[str] | None = None) -> int:
    """A repository as a graph, and the registered queries.

    tools: list the tools. query NAME TABLES [ROWS]: rows of a registered query. init FOLDER STORE: scan a folder and store its graph
    (update is the same, and tells whether something changed). inspect STORE: counts of nodes and edges. report STORE FILE: the
    same as Markdown. export STORE BUNDLE, import BUNDLE STORE: a graph as JSON lines and back. watch FOLDER STORE: what has
    changed in a folder since its files were last listed.
    """
    import argparse

    parser = argparse.ArgumentParser(prog="graphloom", description=main.__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    names = {"tools": (), "query": ("name", "tables"), "init": ("folder", "store"), "update": ("folder", "store"), "inspect": ("store",), "report": ("store", "file"), "export": ("store", "bundle"), "import": ("bundle", "store"), "watch": ("folder", "store")}
    for name, places in names.items():
        one = commands.add_parser(name)
        for place in places:
            one.add_argument(place)
        if name == "query":
            one.add_argument("rows", nargs="?", type=int, default=20)
    asked = parser.parse_args(arguments)
    if asked.command == "tools":
        print("\n".join(sorted(TOOLS)))
        return 0
    try:
        return _run(asked)
    except StoreError as error:
        print(error)
        return 1


def _run(asked) -> int:
    from pyspark.sql import SparkSession

    from graphloom import repository
    from graphloom.plans.catalog import QUERIES

    if asked.command == "query" and asked.name not in QUERIES:
        print(f"no query {asked.name}")
        return 1
    spark = SparkSession.builder.getOrCreate()
    if asked.command == "query":
        for row in QUERIES[asked.name](spark, asked.tables).limit(asked.rows).toJSON().toLocalIterator():
            print(row)
        return 0
    if asked.command in ("init", "update"):
        files = repository.scanned(spark, asked.folder)
        changed = save_graph(repository.repository_graph(files), f"{asked.store}/graph")
        files.select("path", "digest").write.mode("overwrite").parquet(f"{asked.store}/listing")
        print("stored" if changed else "nothing has changed")
        return 0
    if asked.command == "watch":
        listing = f"{asked.store}/listing"
        if load_graph(spark, f"{asked.store}/graph") is None:
            raise StoreError(f"nothing is stored in {asked.store}")
        now = repository.scanned(spark, asked.folder).select("path", "digest")
        for row in snapshot_diff(spark.read.parquet(listing), now, "path", "digest").where("change <> 'same'").orderBy("path").toLocalIterator():
            print(row["change"], row["path"])
        return 0
    if asked.command == "import":
        save_graph(import_bundle(spark, asked.bundle), f"{asked.store}/graph")
        return 0
    graph = load_graph(spark, f"{asked.store}/graph")
    if graph is None:
        raise StoreError(f"nothing is stored in {asked.store}")
    if asked.command == "export":
        print(export_bundle(graph, asked.bundle))
        return 0
    counts = repository.overview(graph).orderBy("part", "kind")
    if asked.command == "report":
        write_report(counts, spark, asked.file, "Repository")
        return 0
    for row in counts.toLocalIterator():
        print(row["part"], row["kind"], row["n"])
    return 0
