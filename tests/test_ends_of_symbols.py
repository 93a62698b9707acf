"""Edges whose ends lie beyond all symbols are sorted out where they are read."""

import re

from pyspark.sql import functions as F

from graphloom.operators import retrieval


def found(spark, symbols):
    chunks = spark.createDataFrame([("c", "a.rs", 3, 5), ("d", "b.rs", 3, 5)], "id string, path string, first int, last int")
    symbols = spark.createDataFrame([(s, "a.rs", 4, 4) for s in symbols], "symbol string, path string, first int, last int")
    edges = spark.createDataFrame([("m1", "z", "Calls"), ("a", "m9", "Uses"), ("m5", "m5", "Calls"), ("a", "z", "Calls"), ("m", "n", "Calls")], "source string, target string, kind string")
    # as in the graphs: distinct rows are shuffled where the edges are made
    edges = edges.distinct()
    modules = chunks.select("path", F.lit("m").alias("module"))
    packages = modules.select("module", F.lit("p").alias("package")).distinct()
    layers = chunks.select("path", F.lit("Api").alias("layer"))
    tags = spark.createDataFrame([("m5", "t")], "id string, tag string")
    return retrieval.enriched_places(chunks, symbols, edges, modules, packages, layers, tags)


def test_ends_beyond_the_symbols_are_not_shuffled(spark):
    places = found(spark, ["m1", "m5", "m9"])
    rows = {r.path: r for r in places.collect()}
    assert [tuple(n) for n in rows["a.rs"].neighbours] == [("Calls", "in", "m5"), ("Calls", "out", "m5"), ("Calls", "out", "z"), ("Uses", "in", "a")]
    assert rows["a.rs"].symbols == ["m1", "m5", "m9"] and rows["a.rs"].tags == ["t"] and rows["b.rs"].neighbours == []
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    # the bounds stand below the edges' distinct(), at both ends
    below = [re.split(r"\n.*Aggregate \[source", plan)[k] for k in (1, 2)]
    assert all(re.search(r"(source|target)#\d+ >= m1\) AND \((source|target)#\d+ <= m9", b) for b in below)


def test_no_symbol_has_no_neighbour(spark):
    assert [(r.path, r.symbols, r.neighbours) for r in found(spark, []).orderBy("path").collect()] == [("a.rs", [], []), ("b.rs", [], [])]
