"""Exact deduplication with a heavy-hitter split; DataFrame operations only.

A Misra-Gries summary (Spark's frequent-items sketch) names digests that may be frequent. Their exact counts decide which
are; those few are broadcast, and their rows get their answer on the map side. All other digests are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE_CLASS, text_of, unused, written

#: Counters of each summary. A digest with a share of HEAVY_SHARE of all rows cannot be missed: the error is under 4 / COUNTERS.
COUNTERS = 8192
#: Summaries are merged in groups first, so the last merge has this many inputs, not one for each task.
MERGE_GROUPS = 64
#: The share of all rows from which a digest is heavy; at most 1 / HEAVY_SHARE digests are.
HEAVY_SHARE = 1 / 1000


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_of(text_col), SPACE_CLASS, " ").cast("binary"), 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of white space (space, 0x09 to 0x0D) is one space; null is empty. The row
    with the smallest id stays. Null ids come last; a group of null ids only has a null keep_id and keeps one row.
    Of repeated rows of the id that stays, one is kept. An empty table gives an empty result; other columns are not read.
    """
    table = written(docs.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("digest")), "digests")
    heavy = written(_heavy(table, heavy_share), "heavy-digests")
    marked = table.join(F.broadcast(heavy), "digest", "left")
    light = Window.partitionBy("digest")
    rest = marked.where("heavy_size IS NULL").select(
        "doc_id",
        F.min("doc_id").over(light).alias("keep_id"),
        F.count(F.lit(1)).over(light).alias("group_size"),
        (F.row_number().over(light.orderBy(F.col("doc_id").asc_nulls_last())) == 1).alias("kept"),
        "digest",
    )
    stays = F.col("doc_id").eqNullSafe(F.col("heavy_id"))
    hot = marked.where("heavy_size IS NOT NULL").withColumns({"keep_id": F.col("heavy_id"), "group_size": F.col("heavy_size")})
    dropped = hot.where(~stays).select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest")
    first = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("group_size")) == 1
    keepers = hot.where(stays).select("doc_id", "keep_id", "group_size", first.alias("kept"), "digest")
    out = rest.unionByName(dropped).unionByName(keepers)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _heavy(table: DataFrame, share: float) -> DataFrame:
    """Digests with at least `share` of the rows (and two rows): digest, heavy_id, heavy_size."""
    rows = table.count()
    groups = table.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(hex(digest), {COUNTERS})").alias("state")
    )
    # grouped by a constant, for without a key a task that has no rows would add a state that can't be merged
    merged = groups.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(state, {COUNTERS})").alias("state"))
    named = merged.select(
        F.expr(f"inline(approx_top_k_estimate(state, {min(COUNTERS, round(2 / share))}))")
    )
    # the sketch's counts are within its error; half the share leaves room, and exact counts decide
    candidates = named.where(F.col("count") >= max(2, rows * share / 2)).select(F.unhex("item").alias("digest"))
    counted = table.join(F.broadcast(candidates), "digest").groupBy("digest")
    return counted.agg(F.min("doc_id").alias("heavy_id"), F.count(F.lit(1)).alias("heavy_size")).where(
        F.col("heavy_size") >= max(2, rows * share)
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text an earlier id has; all columns stay.

    Each row has its own verdict, by its id and text: of repeated rows one stays. Null texts are empty, and one of all empty ones
    stays; a group of null ids only keeps one row; texts of any length are whole; an empty table stays empty.
    """
    own, kept_id, kept, place = (unused(docs.columns, x) for x in ("_own_digest", "_kept_id", "_kept_digest", "_place"))
    stays = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(kept))
    found = docs.withColumn(own, _digest(text_col)).join(stays, (F.col(own) == F.col(kept)) & F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    once = F.row_number().over(Window.partitionBy(own, id_col).orderBy(F.lit(1)))
    return found.withColumn(place, once).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
