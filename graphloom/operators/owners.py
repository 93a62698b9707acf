"""Which module owns a node, where relations in their order push owners on and the last one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import discard, written


def pushed_owners(modules: DataFrame, relations: DataFrame) -> DataFrame:
    """modules: id. relations: source, target, kind, place (their order). id, owner of all nodes that have one.

    Owners are pushed over the relations in their order, again and again: BelongsToModule gives its source the target, if that is
    a module; Contains gives its target what its source has at that time; a module owns itself at first. The last relation that
    gives a node an owner wins, and what is pushed on before that keeps the owner of its time. This is where the passes end up: a
    relation gives what the relation that gave its source last gave, in the same pass or else at the end of the one before; these
    references between relations are followed by doubling. Where they run in a circle, what a module on it was at first goes round;
    without one there is no owner. Of relations at one place the order is that of kind, source, target; repeated ones are one.
    """
    own = written(modules.select("id").where("id IS NOT NULL").distinct(), "modules")
    relations = relations.where("source IS NOT NULL AND target IS NOT NULL AND kind IN ('BelongsToModule', 'Contains')").select("source", "target", "kind", "place").distinct()
    # numbers in the order of the relations: rows sorted by range are numbered partition after partition
    numbered = relations.orderBy("place", "kind", "source", "target").select(F.monotonically_increasing_id().alias("n"), "source", "target", "kind")
    numbered = written(numbered, "relations")
    given = numbered.where("kind = 'BelongsToModule'").join(own.withColumnRenamed("id", "target"), "target", "left_semi")
    given = written(given.select("n", F.col("source").alias("node"), F.col("target").alias("owner")), "given")
    steps = numbered.where("kind = 'Contains'").select("n", F.col("target").alias("node"), F.col("source").alias("of"))
    # what is ever reached: relations whose source never has an owner give nothing
    at = written(own.unionByName(given.select(F.col("node").alias("id"))).distinct(), "owned")
    reached = [at]
    left = written(steps.select("of", "node").distinct().join(at.select(F.col("id").alias("node")).hint("merge"), "node", "left_anti"), "not-owned")
    while not at.isEmpty():
        at = written(left.join(at.select(F.col("id").alias("of")).hint("merge"), "of", "left_semi").select(F.col("node").alias("id")).distinct(), "owned")
        reached.append(at)
        left, old = written(left.join(at.select(F.col("id").alias("node")).hint("merge"), "node", "left_anti"), "not-owned"), left
        discard(old)
    seen = _together(reached)
    passed = written(steps.join(seen.select(F.col("id").alias("of")).hint("merge"), "of", "left_semi").select("n", "node", "of"), "gifts")
    # for each gift from a node's owner, the gift to that node before it, else the last one (of the pass before)
    gifts = given.select("node", "n").unionByName(passed.select("node", "n"))
    events = gifts.withColumn("gives", F.lit(1)).unionByName(passed.select(F.col("of").alias("node"), "n", F.lit(0).alias("gives")))
    ahead = Window.partitionBy("node").orderBy("n", "gives").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("gives") == 1, F.col("n")))
    asked = events.select("node", "n", "gives", last.over(ahead).alias("from"), last.over(Window.partitionBy("node")).alias("last")).where("gives = 0")
    joined = asked.select("n", F.col("node").alias("of"), F.coalesce("from", "last").alias("from")).join(own.select(F.col("id").alias("of"), F.lit(True).alias("is_module")), "of", "left")
    first = F.when(F.col("from").isNull() & F.col("is_module"), F.col("of"))
    # at the very beginning, what a module has not been given yet is itself: this counts on circles only
    begins = F.when((F.col("from") >= F.col("n")) & F.col("is_module"), F.col("of"))
    none = F.lit(None)
    refs = given.select("n", "owner", none.cast("long").alias("from"), none.cast("string").alias("begins")).unionByName(joined.select("n", first.alias("owner"), "from", begins.alias("begins")))
    refs = written(refs, "references")
    state = _followed(refs.select("n", "owner", "from"))
    on_circles = written(refs.join(state.where("owner IS NULL").select("n").hint("merge"), "n", "left_semi"), "circles")
    if not on_circles.isEmpty():
        again = _followed(on_circles.select("n", F.col("begins").alias("owner"), "from"))
        state = state.where("owner IS NOT NULL").unionByName(again)
    ends = gifts.groupBy("node").agg(F.max("n").alias("n")).join(state.hint("merge"), "n").select(F.col("node").alias("id"), "owner")
    every = ends.join(own.withColumn("self", F.col("id")), "id", "full")
    return every.select("id", F.coalesce("owner", "self").alias("owner")).where("owner IS NOT NULL")


def _together(tables: list[DataFrame]) -> DataFrame:
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[x._written_at for x in tables])


def _followed(refs: DataFrame) -> DataFrame:
    """refs: n, owner, from (an n; not followed where there is an owner). n, owner at the end of each chain, null on circles.

    A round doubles the way of those that are open. When a round ends no chain, there is none so long: what is open goes in circles.
    """
    ended = [written(refs.where("owner IS NOT NULL OR `from` IS NULL").select("n", "owner"), "ends")]
    left = written(refs.where("owner IS NULL AND `from` IS NOT NULL").select("n", "from"), "references")
    while not left.isEmpty():
        to = _together(ended).select(F.col("n").alias("from"), "owner", F.lit(None).cast("long").alias("next"))
        to = to.unionByName(left.select(F.col("n").alias("from"), F.lit(None).cast("string").alias("owner"), F.col("from").alias("next")))
        moved = written(left.join(to.hint("merge"), "from", "left").select("n", "owner", F.col("next").alias("from")), "moved")
        now = written(moved.where("owner IS NOT NULL OR `from` IS NULL").select("n", "owner"), "ends")
        if now.isEmpty():
            break
        ended.append(now)
        left, old = written(moved.where("owner IS NULL AND `from` IS NOT NULL").select("n", "from"), "references"), left
        discard(old)
        discard(moved)
    return _together(ended).unionByName(left.select("n", F.lit(None).cast("string").alias("owner")))
