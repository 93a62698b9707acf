"""Which nodes of a layout get a label: the best ones that keep a least distance from each other."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import discard, written

REACH = 2  # cells whose diagonal is the distance: what is nearer than it lies at most two cells away


def labelled(nodes: DataFrame, distance: float, limit: int | None = None) -> DataFrame:
    """nodes: id, priority, x, z, and selected (boolean) if there is one. id of the nodes that get a label, and place (from 1) with a limit.

    By falling priority, then by id (null ids and positions get none; selected nodes come first and always get one), a node is
    taken if none that was taken is nearer than the distance; then the first `limit` stay, and selected ones. This is found in
    rounds: in each cell only the best open node matters; one that is better than the best of all cells within reach is taken,
    and what is too near to it is closed. So no task sees more of a crowd than its best node, and no order is gone through.
    """
    own = F.coalesce("selected", F.lit(False)) if "selected" in nodes.columns else F.lit(False)
    some = nodes.where("id IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL").select("id", F.coalesce("priority", F.lit(0)).alias("priority"), "x", "z", own.alias("selected"))
    side = distance / math.sqrt(2) if distance > 0 else 1.0
    rank = F.struct((~F.col("selected")).alias("a"), (-F.col("priority")).alias("b"), F.col("id").alias("id"))
    rows = some.select("id", "x", "z", "selected", rank.alias("rank"), F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("z") / side).alias("cz"))
    left = written(rows.where("NOT selected"), "open-nodes")
    taken = written(rows.where("selected"), "labels")
    kept = [taken]
    offsets = [(i, j) for i in range(-REACH, REACH + 1) for j in range(-REACH, REACH + 1)]
    around = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cz") + j).alias("cz")) for i, j in offsets]))
    apart = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("z") - F.col("tz")) ** 2)
    while True:
        # what a node that was taken covers is closed; there is at most one taken node in a cell, but for selected ones
        reach = taken.select(F.col("x").alias("tx"), F.col("z").alias("tz"), around.alias("c")).select("tx", "tz", "c.cx", "c.cz")
        covered = left.join(reach, ["cx", "cz"]).where(apart < distance).select("id").distinct()
        gone = covered.unionByName(taken.select("id"))
        left, old = written(left.join(gone, "id", "left_anti"), "open-nodes"), left
        discard(old)
        if left.isEmpty():
            break
        best = written(left.groupBy("cx", "cz").agg(F.min_by(F.struct("id", "x", "z", "selected", "rank"), "rank").alias("n")), "best-of-cells")
        seen = best.select(F.col("n.rank").alias("rank"), around.alias("c")).groupBy("c").agg(F.min("rank").alias("least")).select("c.cx", "c.cz", "least")
        winners = best.join(seen, ["cx", "cz"]).where("n.rank = least").select("n.*", "cx", "cz")
        taken = written(winners.select(*left.columns), "labels")
        discard(best)
        kept.append(taken)
    every = left.sparkSession.read.schema(taken.schema).parquet(*[x._written_at for x in kept])
    if limit is None:
        return every.select("id")
    # the result is bounded by the limit and the selected nodes, so one sort of it is small
    first = every.orderBy("rank").limit(limit).unionByName(every.where("selected")).dropDuplicates(["id"])
    return first.select("id", F.row_number().over(Window.orderBy("rank")).alias("place"))


def span(nodes: DataFrame) -> float:
    """The diagonal of the box around the nodes' x and z; 0 without any."""
    row = nodes.where("x IS NOT NULL AND z IS NOT NULL").agg(F.min("x"), F.max("x"), F.min("z"), F.max("z")).first()
    return 0.0 if row[0] is None else math.hypot(row[1] - row[0], row[3] - row[2])
