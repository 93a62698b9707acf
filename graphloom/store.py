"""Snapshots of graphs, bundles and documents on storage: written if changed, checked when read, recovered after a break."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators.retrieval import graph_digest
from graphloom.schema import EDGE, NODE

#: The version that is written, and the oldest that is read.
VERSION, OLDEST = 2, 1
MANIFEST = "version int, digest string, place string"


class StoreError(Exception):
    """What is stored can't be used."""


def _paths(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _there(spark: SparkSession, path: str) -> bool:
    file_system, at = _paths(spark, path)
    return file_system.exists(at)


def _move(spark: SparkSession, source: str, target: str) -> None:
    file_system, a = _paths(spark, source)
    _, b = _paths(spark, target)
    if file_system.exists(b):
        file_system.delete(b, True)
    file_system.rename(a, b)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """version, digest and place of what is stored; None if nothing is. A manifest that was about to be put in place counts."""
    for name in ("manifest", "manifest.next"):
        if _there(spark, f"{path}/{name}/_SUCCESS"):
            return spark.read.schema(MANIFEST).json(f"{path}/{name}").first().asDict()
    return None


def save_graph(graph: PropertyGraph, path: str) -> bool:
    """Write the graph as Parquet if it differs from what is stored; whether it was written.

    Tables go to a place of their own first, then the manifest names it, so a reader sees the old graph or the new one.
    """
    spark = graph.nodes.sparkSession
    digest = graph_digest(graph).first().digest
    old = manifest(spark, path)
    if old and (old["digest"], old["version"]) == (digest, VERSION):
        return False
    place = f"graph-{digest[:16]}-{VERSION}"
    graph.nodes.select(*NODE.names).write.mode("overwrite").parquet(f"{path}/{place}/nodes")
    graph.edges.select(*EDGE.names).write.mode("overwrite").parquet(f"{path}/{place}/edges")
    spark.createDataFrame([(VERSION, digest, place)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest.next")
    _move(spark, f"{path}/manifest.next", f"{path}/manifest")
    if old and old["place"] != place:
        file_system, at = _paths(spark, f"{path}/{old['place']}")
        file_system.delete(at, True)
    return True


def load_graph(spark: SparkSession, path: str) -> PropertyGraph | None:
    """The stored graph; None if there is none. Older versions are brought up to date, newer ones are an error."""
    found = manifest(spark, path)
    if not found:
        return None
    if found["version"] > VERSION:
        raise StoreError(f"version {found['version']} is newer than {VERSION}")
    if found["version"] < OLDEST:
        raise StoreError(f"version {found['version']} is older than {OLDEST}")
    nodes, edges = (spark.read.parquet(f"{path}/{found['place']}/{x}") for x in ("nodes", "edges"))
    if "path" not in nodes.columns:  # version 1 had no paths
        nodes = nodes.withColumn("path", F.lit(None).cast("string"))
    return PropertyGraph(nodes.select(*NODE.names), edges.select(*EDGE.names))


def export_bundle(graph: PropertyGraph, path: str) -> str:
    """The graph as gzipped JSON lines with its digest beside them; the digest."""
    spark = graph.nodes.sparkSession
    digest = graph_digest(graph).first().digest
    for name, rows in (("nodes", graph.nodes.select(*NODE.names)), ("edges", graph.edges.select(*EDGE.names))):
        rows.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
    spark.createDataFrame([(VERSION, digest, "")], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return digest


def import_bundle(spark: SparkSession, path: str) -> PropertyGraph:
    """The graph of a bundle, if it has the digest that it was exported with; an error otherwise."""
    found = manifest(spark, path)
    if not found:
        raise StoreError(f"no bundle at {path}")
    graph = PropertyGraph(spark.read.schema(NODE).json(f"{path}/nodes"), spark.read.schema(EDGE).json(f"{path}/edges"))
    if graph_digest(graph).first().digest != found["digest"]:
        raise StoreError("the bundle is not what was exported")
    return graph


def save_document(spark: SparkSession, path: str, value, pretty: bool = False) -> bool:
    """Write a JSON document if it differs; whether it was written. It is put in place by a rename."""
    text = json.dumps(value, indent=2 if pretty else None, sort_keys=True, ensure_ascii=False)
    if load_text(spark, path) == text:
        return False
    file_system, at = _paths(spark, path + ".next")
    stream = file_system.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    _move(spark, path + ".next", path)
    return True


def load_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file; None if it is not there. A file that was about to be put in place counts."""
    for name in (path, path + ".next"):
        if _there(spark, name):
            return spark.read.format("binaryFile").load(name).first().content.decode()
    return None


def load_document(spark: SparkSession, path: str, migrations: dict[int, object] | None = None, version: int = VERSION):
    """The JSON document; None if it is not there. Documents with an older "version" go through migrations (from version: function)."""
    text = load_text(spark, path)
    if text is None:
        return None
    value = json.loads(text)
    if migrations is not None:
        while value.get("version", OLDEST) < version:
            own = value.get("version", OLDEST)
            value = {**migrations[own](value), "version": own + 1}
        if value["version"] > version:
            raise StoreError(f"version {value['version']} is newer than {version}")
    return value


def cached(spark: SparkSession, path: str, key: str, make) -> tuple[DataFrame, bool]:
    """The table that is stored under a key, or made and stored now; and whether it was there. A broken one is made anew."""
    place = f"{path}/{key}"
    if _there(spark, f"{place}/_SUCCESS"):
        try:
            found = spark.read.parquet(place)
            found.limit(1).collect()
            return found, True
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "Parquet" not in str(error) and "UNABLE_TO_INFER" not in str(error) and "CANNOT_READ" not in str(error):
                raise
    make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place), False


def write_report(rows: DataFrame, spark: SparkSession, path: str, title: str, most: int = 1000) -> str:
    """A Markdown table of up to `most` rows: the report's text, also stored."""
    columns = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join("-" for _ in columns) + " |"]
    for r in rows.limit(most).toLocalIterator():
        lines.append("| " + " | ".join(str(r[c]).replace("|", "\\|").replace("\n", " ") for c in columns) + " |")
    text = "\n".join(lines) + "\n"
    file_system, at = _paths(spark, path)
    stream = file_system.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    return text
