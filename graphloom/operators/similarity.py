"""Set-similarity self-join by prefix filtering."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import prefixes
from graphloom.storage import ship_package, written


def near_pairs(sets: DataFrame, least: float = 0.6, partition: str = "lang", ident: str = "id", tokens: str = "tokens") -> DataFrame:
    """Pairs of sets of one partition with Jaccard >= least: partition, id_a < id_b, shared, similarity.

    sets: tokens is an array of distinct values. Equal sets are joined once: pairs are of classes (id is the smallest member),
    so copies cost nothing; class_members() tells who belongs to which. Tokens are put in order of their frequency, rarest
    first; two sets that are similar enough share a token among the first n - ceil(least * n) + 1 of each. Tokens, places and
    bitmaps go through one shuffle; only pairs that pass by them are joined with their tokens, and those decide.
    """
    ship_package(sets.sparkSession)
    rows = sets.select(partition, F.col(ident).alias("id"), F.to_json(F.array_sort(tokens)).alias("_json")).where((F.size(tokens) > 0) & F.col(partition).isNotNull())
    classes = rows.groupBy(partition, "_json").agg(F.min("id").alias("_id")).withColumn("_no", F.monotonically_increasing_id())
    classes = written(classes.select(partition, "_no", "_id", "_json"), "sets")
    array = lambda c: F.from_json(c, sets.schema[tokens].dataType)
    hashes = classes.select(F.col("_no").alias("no"), F.transform(array("_json"), lambda w: F.xxhash64(F.col(partition), w)).alias("hashes"))
    bucket = F.shiftrightunsigned("hash", 20).bitwiseAND(F.lit(prefixes.BUCKETS - 1)).cast("int")
    seen = hashes.select(F.explode("hashes").alias("hash")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(prefixes.BUCKETS, np.int32)
    counts[seen["bucket"].to_numpy()] = seen["n"].to_numpy()
    laid = hashes.mapInArrow(partial(prefixes.laid_out, counts, least), prefixes.LAID)
    likely = laid.repartition("key").sortWithinPartitions("key").mapInArrow(partial(prefixes.likely_pairs, least), "a long, b long")
    pairs = written(likely.distinct(), "likely-pairs")
    for x in "ab":
        pairs = pairs.join(classes.select(F.col(partition).alias(f"_of_{x}"), F.col("_no").alias(x), F.col("_id").alias(f"_id_{x}"), F.col("_json").alias(f"_{x}")), x)
    pairs = pairs.where("_of_a = _of_b").withColumns({"_a": array("_a"), "_b": array("_b")}).select(
        F.col("_of_a").alias(partition), F.least("_id_a", "_id_b").alias("id_a"), F.greatest("_id_a", "_id_b").alias("id_b"),
        F.size(F.array_intersect("_a", "_b")).alias("shared"), (F.size("_a") + F.size("_b")).alias("_sum"),
    )
    scored = pairs.select(partition, "id_a", "id_b", F.col("shared").cast("long").alias("shared"), (F.col("shared") / (F.col("_sum") - F.col("shared"))).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def _keyed(sets: DataFrame, partition: str, ident: str, tokens: str) -> DataFrame:
    """partition, id, _tokens (sorted), _key (equal for equal sets)."""
    rows = sets.select(partition, F.col(ident).alias("id"), F.array_sort(tokens).alias("_tokens"))
    return rows.withColumn("_key", F.sha2(F.to_json("_tokens"), 256))


def classes_of(sets: DataFrame, partition: str = "lang", ident: str = "id", tokens: str = "tokens") -> DataFrame:
    """Who has an equal set: partition, id, class (the smallest id). Sets are made once, and written as keys."""
    rows = written(_keyed(sets, partition, ident, tokens).select(partition, "id", "_key"), "set-keys")
    least = rows.groupBy(F.col(partition).alias("_p"), F.col("_key").alias("_k")).agg(F.min("id").alias("class"))
    return rows.join(least, rows[partition].eqNullSafe(F.col("_p")) & (F.col("_key") == F.col("_k"))).select(partition, "id", "class")
