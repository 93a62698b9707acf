"""Incremental maintenance: fingerprints, reuse, ownership, feedback."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import decay
from graphloom.operators.relational import snapshot_diff
from graphloom.storage import ship_package


def row_digest(*columns: str) -> Column:
    """A digest of columns in their order; null and empty differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def fragment_plan(stored: DataFrame, wanted: DataFrame, owner: str) -> DataFrame:
    """Rows with an owner, before and now. owner, action: reused if its rows are the same, whatever their order, rebuilt, deleted.

    Digests of rows are summed, so no fragment is gathered.
    """

    def digests(rows: DataFrame) -> DataFrame:
        one = row_digest(*sorted(c for c in rows.columns if c != owner))
        total = F.sum(F.conv(F.substring(one, 1, 15), 16, 10).cast("decimal(38,0)"))
        return rows.groupBy(owner).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total.cast("string")).alias("digest"))

    change = snapshot_diff(digests(stored), digests(wanted), owner, "digest")
    action = F.when(F.col("change") == "same", "reused").when(F.col("change") == "removed", "deleted").otherwise("rebuilt")
    return change.select(owner, action.alias("action"))


def fingerprint_reasons(stored: DataFrame, wanted: DataFrame, ident: str, parts: list[str]) -> DataFrame:
    """id, reason: the first of the parts of a fingerprint that differs, new if nothing is stored, else same."""
    old = stored.select(ident, *[F.col(p).alias(f"_{p}") for p in parts], F.lit(True).alias("_there"))
    reason = F.when(F.col("_there").isNull(), "new")
    for p in parts:
        reason = reason.when(~F.col(p).eqNullSafe(F.col(f"_{p}")), p)
    return wanted.join(old, ident, "left").select(ident, reason.otherwise("same").alias("reason"))


def reconcile_metrics(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """inserted, updated, reused, deleted, total (of the new snapshot)."""
    change = snapshot_diff(old, new, key, value)
    n = lambda x: F.count_if(F.col("change") == x)
    return change.agg(n("added").alias("inserted"), n("changed").alias("updated"), n("same").alias("reused"), n("removed").alias("deleted"), F.count_if(F.col("change") != "removed").alias("total"))


def reuse_plan(wanted: DataFrame, stored: DataFrame, ident: str, digest: str) -> DataFrame:
    """What each wanted row needs: id, action (Reuse: same id and content, Copy: content known under another id, Compute), and stored ids without a wanted row (Delete)."""
    by_id = stored.select(F.col(ident), F.col(digest).alias("_stored"), F.lit(True).alias("_known"))
    by_content = stored.select(F.col(digest)).distinct().withColumn("_copy", F.lit(True))
    joined = wanted.select(ident, digest).join(by_id, ident, "left").join(by_content, digest, "left")
    action = F.when(F.col("_stored") == F.col(digest), "Reuse").when(F.col("_copy"), "Copy").otherwise("Compute")
    gone = stored.select(ident).join(wanted.select(ident), ident, "left_anti").withColumn("action", F.lit("Delete"))
    return joined.select(ident, action.alias("action")).unionByName(gone)


def reconcile_owners(stored: DataFrame, incoming: DataFrame, scope: str) -> DataFrame:
    """stored, incoming: key, content, owner ("a/b/c"). Actions when the owners under `scope` are replaced: key, action.

    A scope covers an owner that has its path segments in front. Other owners stay. The content of the first owner wins;
    Insert, Update, NoOp or Delete tells what becomes of the key, conflict whether incoming owners disagree with it.
    """
    covered = (F.col("owner") == scope) | F.col("owner").startswith(scope + "/")
    stays = stored.where(~covered).select("key", "content", "owner")
    after = stays.unionByName(incoming.select("key", "content", "owner"))
    new = after.groupBy("key").agg(F.min_by("content", "owner").alias("_new"), (F.count_distinct("content") > 1).alias("conflict"))
    old = stored.groupBy("key").agg(F.min_by("content", "owner").alias("_old"))
    action = F.when(F.col("_old").isNull(), "Insert").when(F.col("_new").isNull(), "Delete").when(F.col("_old") == F.col("_new"), "NoOp").otherwise("Update")
    return old.join(new, "key", "full_outer").select("key", action.alias("action"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def lessons(events: DataFrame, now: int) -> DataFrame:
    """events: node, outcome (useful, dead_end, corrected), recorded_at (seconds). node, useful, negative, score, lesson.

    Scores are whole millionths: recent events weigh more, useful ones count for and the others against.
    """
    weight = decay(F.lit(now), F.col("recorded_at"))
    good = F.col("outcome") == "useful"
    sums = events.groupBy("node").agg(F.count_if(good).alias("useful"), F.count_if(~good).alias("negative"), F.sum(F.when(good, weight).otherwise(-weight)).alias("score"))
    lesson = (
        F.when((F.col("useful") > 0) & (F.col("negative") > 0), "contested")
        .when((F.col("useful") >= 2) & (F.col("score") > 0), "preferred")
        .when((F.col("useful") > 0) & (F.col("score") > 0), "tentative")
        .otherwise("dead_end")
    )
    return sums.withColumn("lesson", lesson)


def pack_in_order(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Sequential buckets: a row that would take a group's bucket over the budget opens the next one. group, order, bucket.

    Rows of a group are sorted and go by, one after the other; of a group only the running bucket is kept.
    """
    types = dict(rows.dtypes)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket, used = None, 0, 0
        for batch in batches:
            out = []
            for g, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if last is None or g != last[0]:
                    last, bucket, used = (g,), 0, 0
                n = n or 0
                if used > 0 and used + n > budget:
                    bucket, used = bucket + 1, 0
                used += n
                out.append(bucket)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=[group, order, "bucket"])

    ship_package(rows.sparkSession)
    ordered = rows.select(group, order, F.col(size).cast("long").alias(size)).repartition(parts, group).sortWithinPartitions(group, order, size)
    return ordered.mapInArrow(pack, f"`{group}` {types[group]}, `{order}` {types[order]}, bucket int")
