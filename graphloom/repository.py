"""A repository of files as a property graph: what the command line builds, stores and looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import classify
from graphloom.functions.paths import basename
from graphloom.graph import PropertyGraph
from graphloom.operators import facts
from graphloom.sources.files import read_facts, walk
from graphloom.storage import written


def texts(files: DataFrame) -> DataFrame:
    """files: path, content (bytes), size_bytes. path, digest, size_bytes, n_lines, content (text; null for binary files), analyzer."""
    digest, status, lines = read_facts(F.col("content"))
    rows = files.select("path", "size_bytes", digest.alias("digest"), (status == "Binary").alias("binary"), lines.alias("n_lines"), F.when(status == "Text", F.col("content").cast("string")).alias("content"))
    found = classify.classified(rows, binary=F.col("binary"))
    return found.withColumn("analyzer", F.when(F.col("policy") != "Never", classify.analyzer(F.col("path"), F.col("format"), F.col("analyzer"))))


def repository_graph(files: DataFrame) -> PropertyGraph:
    """files: path, analyzer, content. Artifacts and what their facts name as nodes, typed edges between them.

    A node that several edges name with different labels has the smallest one. Files that are there twice are one node.
    """
    edges = written(facts.typed_edges(files), "typed-edges")
    artifacts = files.select(F.concat(F.lit("artifact:"), "path").alias("id"), F.lit("Artifact").alias("label"), basename(F.col("path")).alias("name"), "path")
    named = edges.where("label <> 'Artifact'").groupBy(F.col("target").alias("id")).agg(F.min("label").alias("label"))
    place = F.regexp_extract("id", "^(?:command|doc|config):(.*?)#", 1)
    others = named.select("id", "label", F.expr("substring(id, instr(id, ':') + 1)").alias("name"), F.nullif(place, F.lit("")).alias("path"))
    return PropertyGraph(artifacts.dropDuplicates(["id"]).unionByName(others), edges.select("id", "source", "target", "kind"))


def scanned(spark: SparkSession, folder: str, ignores: DataFrame | None = None) -> DataFrame:
    """The files under a folder as repository_graph() takes them, written once."""
    return written(texts(walk(spark, folder, ignores=ignores)), "scanned-files")


def overview(graph: PropertyGraph) -> DataFrame:
    """part (nodes, edges), kind, n: how many nodes of each label and edges of each kind."""
    nodes = graph.nodes.groupBy(F.col("label").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    edges = graph.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select(F.lit("nodes").alias("part"), "kind", "n").unionByName(edges.select(F.lit("edges").alias("part"), "kind", "n"))
