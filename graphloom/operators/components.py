"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import apart, discard, written


def components(links: DataFrame) -> DataFrame:
    """links: columns u, v (not null). One row for each end of a link: node, root (the smallest node it reaches).

    Each round writes its links, so lost executors repeat one round at most. Hubs are aggregated by partial minima and
    joined by sorting, never gathered; no copies of the links go through the driver. An empty table gives an empty result; repeated links and u = v are ignored.
    """
    now = written(_down(links), "links")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
        last, now = now, written(_small_star(_large_star(now)), "links")
        discard(last)


def _down(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller end."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of those."""
    down = _down(links)
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(apart(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _down(moved.unionByName(least.select("u", F.col("m").alias("v"))))
