"""Kept results: what changes a digest, what a second call reads, what is removed."""

import pytest
from pyspark.sql import functions as F

from graphloom import kept


def test_digest(spark):
    rows = [(1, "a", None, {"k": "v"}), (2, None, 1.5, None), (2, None, 1.5, None)]
    base = spark.createDataFrame(rows, "i int, s string, d double, m map<string,string>")
    same = kept.table_digest(base)
    assert kept.table_digest(base.repartition(3).select("m", "d", "i", "s")) == same
    others = [base.dropDuplicates(["i"]), base.withColumn("i", F.col("i").cast("long")), base.withColumnRenamed("s", "t"), base.limit(0), base.withColumn("d", F.coalesce("d", F.lit(0.0))), base.withColumn("s", F.coalesce("s", F.lit("")))]
    assert len({same, *map(kept.table_digest, others)}) == 7
    assert kept.table_digest(spark.createDataFrame([("", None)], "a string, b string")) != kept.table_digest(spark.createDataFrame([(None, "")], "a string, b string"))


def test_results(spark, tmp_path):
    spark.range(20).select(F.col("id").alias("u"), (F.col("id") % 4).alias("v")).write.parquet(f"{tmp_path}/links")
    links = lambda: spark.read.parquet(f"{tmp_path}/links")
    store = kept.Kept(spark, f"file://{tmp_path}/kept")
    first = sorted(map(tuple, kept.components(store, links()).collect()))
    assert (store.hits, store.misses) == (0, 1) and len(first) == 20
    # the second call runs no job over the input: its files' names, sizes and times are enough
    seen = []
    old, kept.table_digest = kept.table_digest, lambda table: seen.append(table) or old(table)
    try:
        assert sorted(map(tuple, kept.components(store, links()).collect())) == first
        assert not seen and (store.hits, store.misses) == (1, 1)
        # another input, another parameter and another version are other results
        spark.range(3).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")).write.mode("append").parquet(f"{tmp_path}/links")
        kept.components(store, links())
        assert len(seen) == 1
    finally:
        kept.table_digest = old
    store.result("components", 2, {}, {"links": links()}, links)
    store.result("components", 2, {"x": 1}, {"links": links()}, links)
    assert (store.hits, store.misses) == (1, 4)
    again = kept.Kept(spark, f"file://{tmp_path}/kept")
    kept.components(again, links())
    assert again.hits == 1 and again.remove_orphans() == 3 and again.remove_orphans() == 0
    kept.components(again, links())
    assert again.hits == 2


def test_a_table_in_memory_is_digested_each_time(spark, tmp_path):
    store = kept.Kept(spark, f"file://{tmp_path}/kept")
    nodes = spark.createDataFrame([("a", 1, 0.0, 0.0), ("b", 2, 1.0, 0.0)], "id string, priority int, x double, z double")
    assert [r.id for r in kept.labelled(store, nodes, 5.0).collect()] == ["b"]
    assert [r.id for r in kept.labelled(store, nodes.repartition(2), 5.0).collect()] == ["b"] and store.hits == 1
    with pytest.raises(ZeroDivisionError):
        store.result("x", 1, {}, {"n": nodes}, lambda: 1 / 0)
    assert store.remove_orphans() == 0
