"""Chunks of one place share what their place has: pairs of chunks and symbols are not laid out."""

from pyspark.sql import functions as F

from graphloom.operators import retrieval


def test_chunks_of_one_place_are_enriched_once(spark, monkeypatch):
    rows = spark.range(40)
    at = [F.lit("a.rs").alias("path"), F.lit(3).alias("first"), F.lit(5).alias("last")]
    chunks = rows.select(F.format_string("c%02d", "id").alias("id"), *at)
    symbols = rows.select(F.format_string("s%02d", "id").alias("symbol"), *at)
    edges = symbols.select(F.col("symbol").alias("source"), F.lit("x").alias("target"), F.lit("Calls").alias("kind"))
    modules = chunks.select("path", F.lit("m").alias("module")).distinct()
    packages = modules.select("module", F.lit("p").alias("package"))
    layers = modules.select("path", F.lit("Api").alias("layer"))
    tags = symbols.select(F.col("symbol").alias("id"), F.lit("t").alias("tag"))
    laid = []
    plain = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: (laid.append(df.count()), plain(df, name))[1])
    found = retrieval.enriched(chunks, symbols, edges, modules, packages, layers, tags).collect()
    assert laid == [40]
    assert sorted(r.id for r in found) == [f"c{k:02d}" for k in range(40)]
    assert all(r.symbols == [f"s{k:02d}" for k in range(40)] and r.tags == ["t"] and [tuple(n) for n in r.neighbours] == [("Calls", "out", "x")] for r in found)
