"""Sequential cuts by a budget, found in parallel: prefix sums, where the next part would begin from each row, and what is reached.

Orders are dealt by range and numbered in blocks, so no group is one task, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import discard, written

#: Rounds of doubling before which rows that no jump ends at are left out.
THINNED = 4


def blocked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows, written, with _block and _at: a group's rows are in the order of (_block, _at), and a block is a part of a task."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    return written(dealt.withColumns({"_block": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)


def running(rows: DataFrame, group: str, values: dict[str, Column]) -> DataFrame:
    """rows of blocked() with running sums of values, each row's own included: within a block, and of blocks before it."""
    inside = Window.partitionBy(group, "_block").orderBy("_at")
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col(group).alias("_g"), F.col("_block").alias("_b")).agg(*[F.sum(v).alias(f"_{k}") for k, v in values.items()])
    carried = sums.select("_g", "_b", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in values])
    joined = rows.join(carried, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
    return joined.select(*rows.columns, *[(F.sum(v).over(inside) + F.col(f"_{k}")).alias(k) for k, v in values.items()])


def cut_by_budget(rows: DataFrame, group: str, order: list[str], size: str, budget: float) -> DataFrame:
    """group, the order's columns, size, part (from 0): a row that would take its part over the budget begins the next one.

    A row of more than the budget is a part of its own. Rows of a group are taken in their order (equal ones in any, as they are
    alike); a null size is 0, a null group is a group. Sizes must not be negative. An empty table gives an empty result.
    """
    some = rows.select(group, *order, F.coalesce(F.col(size), F.lit(0)).alias(size))
    placed = written(running(blocked(some, group, [*order, size], "in-order"), group, {"_end": F.col(size), "_n": F.lit(1)}), "prefix-sums")
    # the first row whose prefix sum is beyond what the budget allows from a row on, in the order of the sums
    ends = placed.select(group, F.col("_end").alias("_v"), F.lit(0).alias("_kind"), F.col("_n").alias("_i"))
    asks = placed.select(group, (F.col("_end") - F.col(size) + budget).alias("_v"), F.lit(1).alias("_kind"), F.col("_n").alias("_i"))
    events = blocked(ends.unionByName(asks), group, ["_v", "_kind", "_i"], "sums-in-order")
    row = F.when(F.col("_kind") == 0, F.col("_i"))
    after = Window.partitionBy(group, "_block").orderBy(F.desc("_at"))
    later = Window.partitionBy("_g").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = events.groupBy(F.col(group).alias("_g"), F.col("_block").alias("_b")).agg(F.min(row).alias("_first"))
    firsts = firsts.select("_g", "_b", F.min("_first").over(later).alias("_later"))
    found = events.join(firsts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
    found = found.withColumn("_next", F.coalesce(F.last(row, ignorenulls=True).over(after), F.col("_later"))).where("_kind = 1")
    jumps = written(found.select(F.col(group).alias("_g"), F.col("_i").alias("_from"), F.greatest("_next", F.col("_i") + 1).alias("_to"), "_next").where("_next IS NOT NULL").drop("_next"), "jumps")
    same = F.col("_g").eqNullSafe(F.col("_h"))
    starts = written(placed.where("_n = 1").select(F.col(group).alias("_g"), F.col("_n").alias("_from")), "part-starts")
    last = placed.groupBy(F.col(group).alias("_g")).agg(F.max("_n").alias("_last"))
    jumps = written(jumps.join(last.withColumnRenamed("_g", "_h"), same).where("_to <= _last").select("_g", "_from", "_to"), "jumps")
    levels = []
    while not jumps.isEmpty():
        level = jumps
        if len(levels) < THINNED:
            # a part begins where a jump ends or with the first row, so longer jumps are made from such rows only; they soon get no fewer
            ends = jumps.select(F.col("_g").alias("_h"), F.col("_to").alias("_f")).unionByName(starts.select(F.col("_g").alias("_h"), F.col("_from").alias("_f"))).distinct()
            level = written(jumps.join(ends, same & (F.col("_from") == F.col("_f")), "left_semi"), "jumps")
            discard(jumps)
        levels.append(level)
        twice = levels[-1].join(levels[-1].select(F.col("_g").alias("_h"), F.col("_from").alias("_mid"), F.col("_to").alias("_end")), same & (F.col("_to") == F.col("_mid")))
        jumps = written(twice.select("_g", "_from", F.col("_end").alias("_to")), "jumps")
    for level in reversed(levels):
        # starts are every 2^k-th one by now; those half way between them are added
        more = starts.select(F.col("_g").alias("_h"), "_from").join(level.withColumnRenamed("_from", "_f"), same & (F.col("_from") == F.col("_f")))
        old, starts = starts, written(starts.unionByName(more.select("_g", F.col("_to").alias("_from"))), "part-starts")
        discard(old)
        discard(level)
    marks = starts.select(F.col("_g"), F.col("_from"), F.lit(1).alias("_mark"))
    marked = placed.join(marks, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_n") == F.col("_from")), "left").drop("_g", "_from")
    numbered = running(written(marked, "marked"), group, {"_part": F.coalesce("_mark", F.lit(0))})
    return numbered.select(group, *order, size, (F.col("_part") - 1).cast("long").alias("part"))
