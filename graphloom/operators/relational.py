"""Joins the built-in ones do not name: intervals, unique matches, suffixes, ordered resolvers, snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of one bin of the interval joins.
BIN = 64


def _binned(df: DataFrame, first: str, last: str, bin_size: int) -> DataFrame:
    bins = F.sequence(F.floor(F.col(first) / bin_size), F.floor(F.col(last) / bin_size))
    return df.where(F.col(first) <= F.col(last)).withColumn("_bin", F.explode(bins))


def stabbing_join(points: DataFrame, spans: DataFrame, key: str, at: str, first: str, last: str, bin_size: int = BIN) -> DataFrame:
    """Every (point, span) of one key with first <= at <= last. Spans are spread over bins, so the join is an equi-join."""
    left = points.withColumn("_bin", F.floor(F.col(at) / bin_size))
    joined = left.join(_binned(spans, first, last, bin_size), [key, "_bin"])
    return joined.where((F.col(at) >= F.col(first)) & (F.col(at) <= F.col(last))).drop("_bin")


def innermost_join(points: DataFrame, spans: DataFrame, key: str, at: str, first: str, last: str, span_id: str, point_id: str) -> DataFrame:
    """For each point the shortest span around it, ties by span id: point_id, span_id."""
    found = stabbing_join(points, spans, key, at, first, last)
    best = F.min_by(span_id, F.struct(F.col(last) - F.col(first), F.col(span_id)))
    return found.groupBy(key, point_id).agg(best.alias(span_id))


def overlap_join(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], bin_size: int = BIN) -> DataFrame:
    """Every pair of one key whose spans share a line; a pair that meets in several bins is kept in its first common one."""
    joined = _binned(left, *a, bin_size).join(_binned(right, *b, bin_size), [key, "_bin"])
    meet = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / bin_size)
    return joined.where((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) & (F.col("_bin") == meet)).drop("_bin")


def unique_match(refs: DataFrame, names: DataFrame, on: str, ident: str) -> DataFrame:
    """refs with the one id that has its name; refs whose name no or several ids have are left out."""
    single = names.groupBy(on).agg(F.count_distinct(ident).alias("_n"), F.min(ident).alias(ident)).where("_n = 1").drop("_n")
    return refs.join(single, on)


def suffix_match(refs: DataFrame, names: DataFrame, ref: str, qualified: str, ident: str, separator: str = "::") -> DataFrame:
    """refs with the one id whose qualified name is the ref or ends in separator + ref. Suffixes are laid out, so it is an equi-join."""
    parts = F.split(F.col(qualified), F.lit("\\Q" + separator + "\\E"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), separator))
    laid = names.select(F.col(ident), F.explode(F.array_distinct(suffixes)).alias(ref))
    return unique_match(refs, laid, ref, ident)


def first_resolved(refs: DataFrame, key: str, candidates: list[tuple[str, DataFrame]], ident: str) -> DataFrame:
    """candidates: (strategy, DataFrame of key and ident) in order of priority. Each ref's first hit: key, ident, strategy."""
    out = refs
    for name, found in candidates:
        out = out.join(found.select(key, F.col(ident).alias(f"_{name}")), key, "left")
    hits = [F.when(F.col(f"_{name}").isNotNull(), F.struct(F.col(f"_{name}").alias("id"), F.lit(name).alias("by"))) for name, _ in candidates]
    chosen = F.coalesce(*hits)
    return out.select(key, chosen["id"].alias(ident), F.coalesce(chosen["by"], F.lit("unresolved")).alias("strategy"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (added, removed, changed, same) of two keyed snapshots; a null value is a value."""
    a = old.select(F.col(key), F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    change = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def cache_plan(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """wanted, stored: key, digest. key, action: reused (same key and content are stored), computed, dropped (stored, not wanted)."""
    change = snapshot_diff(stored, wanted, "key", "digest")
    action = F.when(F.col("change") == "same", "reused").when(F.col("change") == "removed", "dropped").otherwise("computed")
    return change.select("key", action.alias("action"))


def coupling_matrix(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """groups: name (few). All ordered pairs of different groups with the count of cells (a, b, n), zero where there is none."""
    names = groups.select("name").distinct()
    pairs = names.select(F.col("name").alias("a")).join(names.select(F.col("name").alias("b")), F.col("a") != F.col("b"))
    return pairs.join(cells, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def aliases(name: Column) -> Column:
    """The distinct spellings of a name: as it is, upper and lower snake, kebab, dotted, without separators."""
    words = F.filter(F.split(F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+"), lambda w: w != "")
    joined = [F.array_join(words, s) for s in ("_", "-", ".", "")]
    return F.array_distinct(F.array(name, F.upper(joined[0]), *joined))


def alias_links(left: DataFrame, right: DataFrame, name: str, left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id where a spelling is shared and exactly one right row fits; left_id with n_candidates > 1 is ambiguous."""
    a = left.select(left_id, F.explode(aliases(F.col(name))).alias("_alias"))
    b = right.select(right_id, F.explode(aliases(F.col(name))).alias("_alias"))
    found = a.join(b, "_alias").select(left_id, right_id).distinct()
    return found.groupBy(left_id).agg(F.count(F.lit(1)).alias("n_candidates"), F.min(right_id).alias(right_id))
