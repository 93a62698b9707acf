"""Plans over files: trees, areas, modules within a ceiling and a token budget, pages and what makes them stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import basename, parent
from graphloom.functions.text import estimated_tokens
from graphloom.operators.budget import cut_by_budget
from graphloom.operators.relational import snapshot_diff

# Most modules of a plan, tokens of a part of one, top folders whose members are areas of their own.
CEILING, PART_TOKENS = 40, 6_000
AREA_FOLDERS = ("src", "apps", "packages", "services", "crates")
BUCKET_CATEGORIES, BUCKET_FOLDERS = ("Documentation", "ContinuousIntegration"), ("crates", "services")


def file_tree(files: DataFrame) -> DataFrame:
    """files: path. path, parent, name, is_dir, depth of all files and the folders around them."""
    parts = F.split("path", "/")
    rows = files.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("pos", "node"), F.size(parts).alias("n"))
    nodes = rows.select(F.col("node").alias("path"), (F.col("pos") + 1 < F.col("n")).alias("is_dir"), (F.col("pos") + 1).alias("depth")).distinct()
    return nodes.select("path", F.nullif(parent(F.col("path")), F.lit("")).alias("parent"), basename(F.col("path")).alias("name"), "is_dir", "depth")


def area_of(path: Column) -> Column:
    """The first folder of a path, or the first two below folders that hold packages."""
    parts = F.split(path, "/")
    return F.when(F.element_at(parts, 1).isin(*AREA_FOLDERS) & (F.size(parts) > 2), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.element_at(parts, 1))


def areas(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id, path. edges: source, target. area, n_files, outgoing, incoming (edges to and from others), connected (areas)."""
    own = nodes.select("id", area_of(F.col("path")).alias("area"))
    ends = edges.join(own.select(F.col("id").alias("source"), F.col("area").alias("x")), "source").join(own.select(F.col("id").alias("target"), F.col("area").alias("y")), "target").where("x <> y")
    sides = ends.select(F.explode(F.array(
        F.struct(F.col("x").alias("area"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("y").alias("other")),
        F.struct(F.col("y").alias("area"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.col("x").alias("other")),
    )).alias("s")).select("s.*")
    counts = sides.groupBy("area").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.count_distinct("other").alias("connected"))
    files = own.groupBy("area").agg(F.count(F.lit(1)).alias("n_files"))
    return files.join(counts, "area", "left").select("area", "n_files", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("outgoing", "incoming", "connected")))


def bucket_of(path: Column, category: Column) -> Column:
    """What a file is planned with: its package's folder, its category if that stands for itself, else its top folder."""
    parts = F.split(path, "/")
    package = F.element_at(parts, 1).isin(*BUCKET_FOLDERS)
    return F.when(package, F.array_join(F.slice(parts, 1, 2), "/")).when(category.isin(*BUCKET_CATEGORIES), category).otherwise(F.element_at(parts, 1))


def modules(files: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """files: path, size_bytes, bucket. bucket, members, tokens, digest (of the members), module.

    If there are more buckets than the ceiling, those behind the largest ceiling - 1 are one module, "other".
    """
    tokens = F.sum(estimated_tokens(F.col("size_bytes"))).cast("long")
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("path")), "\n").cast("binary"), 256)
    buckets = files.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), tokens.alias("tokens"), digest.alias("digest"))
    most = buckets.orderBy(F.desc("members"), "bucket").limit(ceiling + 1)
    # the list of names is ceiling + 1 rows
    named = most.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("members")).alias("m"), "bucket"))), lambda x: x["bucket"]).alias("names"))
    kept = F.when(F.size("names") <= ceiling, F.col("names")).otherwise(F.slice("names", 1, ceiling - 1))
    joined = buckets.crossJoin(F.broadcast(named.select(kept.alias("kept"))))
    return joined.select("bucket", "members", "tokens", "digest", F.when(F.array_contains("kept", F.col("bucket")), F.col("bucket")).otherwise("other").alias("module"))


def page_inputs(members: DataFrame) -> DataFrame:
    """members: page, path, digest. page, digest of all that goes into it."""
    every = F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: F.concat(x["path"], F.lit(":"), x["digest"]))
    return members.groupBy("page").agg(F.sha2(F.array_join(every, "\n").cast("binary"), 256).alias("digest"))


def stale_pages(stored: DataFrame, wanted: DataFrame, settings_changed: bool = False) -> DataFrame:
    """page, state: new, stale (its input or the settings changed), fresh, removed."""
    changed = snapshot_diff(stored, wanted, "page", "digest")
    state = F.when(F.col("change") == "added", "new").when(F.col("change") == "removed", "removed").when((F.col("change") == "changed") | F.lit(settings_changed), "stale").otherwise("fresh")
    return changed.select("page", state.alias("state"))


def affected_pages(members: DataFrame, changed: DataFrame) -> DataFrame:
    """members: page, id. changed: id. The pages that have one of them."""
    return members.join(changed, "id", "left_semi").select("page").distinct()


def merged_by_kind(modules_: DataFrame, least: int) -> DataFrame:
    """modules_: module, kind, members. module, target: modules with fewer than `least` members go together with those of their kind."""
    small = F.col("members") < least
    return modules_.select("module", F.when(small, F.concat(F.lit("group:"), "kind")).otherwise(F.col("module")).alias("target"))


def parts_of(members: DataFrame, group: str, order: str, size: str, budget: int = PART_TOKENS) -> DataFrame:
    """Where the members of a module are cut so that no part has more than the budget: group, order, size, part (from 0).

    As budget.cut_by_budget(): one member after the other, and one that is larger than the budget is a part of its own.
    """
    return cut_by_budget(members, group, [order], size, budget)
