"""Graphs and corpora over Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def _nodes(df: DataFrame, prefix: str, key: str, label: str, name: Column) -> DataFrame:
    return df.select(_id(prefix, key).alias("id"), F.lit(label).alias("label"), name.alias("name"), F.lit(None).cast("string").alias("path"))


def _edges(df: DataFrame, source: Column, target: Column, kind: str, key: Column | None = None) -> DataFrame:
    name = F.concat_ws("|", F.lit(kind), source, target, *([key] if key is not None else []))
    return df.select(name.alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"))


def commerce_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders; parallel Contains edges are kept."""
    t = lambda name: table(spark, sf_dir, name)
    nodes = _nodes(t("region"), "region", "r_regionkey", "Region", F.col("r_name"))
    nodes = nodes.unionByName(_nodes(t("nation"), "nation", "n_nationkey", "Nation", F.col("n_name")))
    nodes = nodes.unionByName(_nodes(t("customer"), "customer", "c_custkey", "Customer", F.col("c_name")))
    nodes = nodes.unionByName(_nodes(t("supplier"), "supplier", "s_suppkey", "Supplier", F.col("s_name")))
    nodes = nodes.unionByName(_nodes(t("part"), "part", "p_partkey", "Part", F.col("p_name")))
    nodes = nodes.unionByName(_nodes(t("orders"), "order", "o_orderkey", "Order", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string"))))
    edges = _edges(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "BelongsTo")
    edges = edges.unionByName(_edges(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "BelongsTo"))
    edges = edges.unionByName(_edges(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "BelongsTo"))
    edges = edges.unionByName(_edges(t("orders"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "PlacedBy"))
    lines = t("lineitem")
    edges = edges.unionByName(_edges(lines, _id("order", "l_orderkey"), _id("part", "l_partkey"), "Contains", F.col("l_linenumber").cast("string")))
    pairs = lines.select("l_partkey", "l_suppkey").distinct()
    edges = edges.unionByName(_edges(pairs, _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "SuppliedBy"))
    return PropertyGraph(nodes, edges)


def link_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Pages and what their hrefs name: a page with that URL path, else an Unresolved node. Parallel edges are kept."""
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^[^/]*//[^/?#]*([^?#]*)", 1)
    nodes = pages.select(_id("page", "page_id").alias("id"), F.lit("Page").alias("label"), F.col("url").alias("name"), path.alias("path"))
    hrefs = pages.select(
        _id("page", "page_id").alias("source"),
        F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("pos", "href"),
    )
    by_path = nodes.groupBy("path").agg(F.min("id").alias("page"))
    found = hrefs.join(by_path, hrefs["href"] == by_path["path"], "left")
    target = F.coalesce("page", F.concat(F.lit("unresolved:"), F.col("href")))
    edges = found.select(
        F.concat_ws("|", F.lit("References"), "source", F.col("pos").cast("string")).alias("id"), "source", target.alias("target"), F.lit("References").alias("kind")
    )
    missing = found.where("page IS NULL").select("href").distinct()
    unresolved = missing.select(
        F.concat(F.lit("unresolved:"), F.col("href")).alias("id"), F.lit("Unresolved").alias("label"), F.col("href").alias("name"), F.lit(None).cast("string").alias("path")
    )
    return PropertyGraph(nodes.unionByName(unresolved), edges)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an event's type and the type of the same user's next one: source, target, n."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    later = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select(F.col("event_type").alias("source"), later.alias("target")).where("target IS NOT NULL")
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document: doc_id, lang, line (from 1), text."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("doc_id", "lang", (F.col("pos") + 1).cast("long").alias("line"), "text")
