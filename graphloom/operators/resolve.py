"""What a reference names: imports without endings, aliases, package roots, prefixes, builtins, re-exports, inherited methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import parent, resolved
from graphloom.operators.propagate import first_inherited as inherited_methods
from graphloom.operators.propagate import layers as topological_layers  # noqa: F401
from graphloom.storage import apart, written


def import_targets(imports: DataFrame, files: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """imports: path, spec (relative). files: path. path, spec, target: the first of spec, spec + ending that is a file; null if none is."""
    base = resolved(F.col("path"), F.col("spec"))
    tried = imports.select("path", "spec", F.posexplode(F.array(base, *[F.concat(base, F.lit(e)) for e in endings])).alias("at", "target"))
    hit = tried.join(files.select(F.col("path").alias("target")).distinct(), "target").groupBy("path", "spec").agg(F.min_by("target", "at").alias("target"))
    return imports.select("path", "spec").join(hit, ["path", "spec"], "left").select("path", "spec", "target")


def package_root(spec: Column) -> Column:
    """The package of an import: its first part, or two parts behind an @; null for relative ones."""
    parts = F.split(spec, "/")
    scoped = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, 2), "/"))
    return F.when(spec.startswith(".") | spec.startswith("/"), None).when(spec.startswith("@"), scoped).otherwise(F.element_at(parts, 1))


def longest_prefix(refs: DataFrame, names: DataFrame, spec: str, name: str, separator: str = "/") -> DataFrame:
    """refs with the longest name that is the spec or a prefix of it before a separator. All prefixes are laid out, so it is an equi-join."""
    parts = F.split(F.col(spec), F.lit("\\Q" + separator + "\\E"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), separator))
    laid = refs.select(spec).distinct().select(spec, F.explode(prefixes).alias(name)).join(names.select(name).distinct(), name)
    best = laid.groupBy(spec).agg(F.max_by(name, F.length(name)).alias(name))
    return refs.join(best, spec, "left").select(*refs.columns, name)


def alias_targets(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports: path, spec. aliases: folder, base_url, pattern (one * at most), target. path, spec, target.

    The nearest folder above the path that has aliases decides, there the longest fixed part before the *; what the * stands
    for is put into the target. Folders above a path are laid out, so it is an equi-join.
    """
    parts = F.split(parent(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    laid = imports.select("path", "spec", F.explode(above).alias("folder"))
    near = laid.join(aliases.select("folder").distinct(), "folder").groupBy("path", "spec").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    head, tail = F.substring_index("pattern", "*", 1), F.when(F.col("pattern").contains("*"), F.substring_index("pattern", "*", -1)).otherwise("")
    star = F.col("pattern").contains("*")
    fits = F.when(star, F.col("spec").startswith(head) & F.col("spec").endswith(tail) & (F.length("spec") >= F.length(head) + F.length(tail))).otherwise(F.col("spec") == F.col("pattern"))
    middle = F.substr("spec", F.length(head) + 1, F.length("spec") - F.length(head) - F.length(tail))
    found = near.join(aliases, "folder").where(fits)
    target = F.concat_ws("/", "folder", F.nullif(F.col("base_url"), F.lit("")), F.when(star, F.replace(F.col("target"), F.lit("*"), middle)).otherwise(F.col("target")))
    best = found.groupBy("path", "spec").agg(F.max_by(target, F.struct(F.length(head), -F.length("target"))).alias("target"))
    return imports.join(best, ["path", "spec"], "left").select("path", "spec", "target")


def builtins(refs: DataFrame, known: DataFrame) -> DataFrame:
    """refs: name, language. known: name, language (a bounded list). refs with label External or Unresolved, and the package of the first."""
    hit = known.select("name", "language").distinct().withColumn("_hit", F.lit(True))
    out = refs.join(hit, ["name", "language"], "left")
    external = F.coalesce("_hit", F.lit(False))
    package = F.when(external, F.concat(F.lit("package:"), "language", F.lit("-builtins")))
    return out.select(*refs.columns, F.when(external, "External").otherwise("Unresolved").alias("label"), package.alias("package"))


def re_exports(wanted: DataFrame, exports: DataFrame, defined: DataFrame, longest: int = 8) -> DataFrame:
    """wanted: file, name. exports: file, name, from_file, from_name (* passes every name on). defined: file, name.

    file, name, origin, origin_name, depth: where the name is defined, along re-exports of at most `longest` steps; of several,
    the nearest, then the smallest. Names that were looked for already are not followed again, so circles end.
    """
    exports, defined = written(exports, "exports"), written(defined.select("file", "name").distinct(), "defined")
    at = written(wanted.select("file", "name").distinct().select("file", "name", F.col("file").alias("at"), F.col("name").alias("as")).withColumn("depth", F.lit(0)), "asked")
    seen, found = at.select("file", "name", "at", "as"), None
    for depth in range(longest + 1):
        here = at.join(defined.select(F.col("file").alias("at"), F.col("name").alias("as")), ["at", "as"], "left_semi").select("file", "name", "at", "as", "depth")
        found = here if found is None else found.unionByName(here)
        if depth == longest:
            break
        e = exports.select(F.col("file").alias("at"), F.col("name").alias("exported"), "from_file", "from_name")
        step = at.join(e, "at").where((F.col("exported") == F.col("as")) | (F.col("exported") == "*"))
        name = F.when(F.col("exported") == "*", F.col("as")).otherwise(F.col("from_name"))
        new = step.select("file", "name", F.col("from_file").alias("at"), name.alias("as")).distinct().join(seen, ["file", "name", "at", "as"], "left_anti")
        at = written(new.withColumn("depth", F.lit(depth + 1)), "asked")
        if at.isEmpty():
            break
        seen = seen.unionByName(at.select("file", "name", "at", "as"))
    best = found.groupBy("file", "name").agg(F.min(F.struct("depth", "at", "as")).alias("x"))
    return best.select("file", "name", F.col("x.at").alias("origin"), F.col("x.as").alias("origin_name"), F.col("x.depth").alias("depth"))


def member_calls(calls: DataFrame, bindings: DataFrame, inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """calls: file, receiver, method. bindings: file, receiver, class. What each call names, through inherited methods: owner, depth."""
    bound = calls.join(bindings, ["file", "receiver"])
    own = inherited_methods(bound.select("class"), inherits, methods)
    return bound.join(own, ["class", "method"], "left").select("file", "receiver", "method", "class", "owner", "depth")


def extended_aliases(configs: DataFrame, aliases: DataFrame) -> DataFrame:
    """configs: path, extends (may be null). aliases: path, pattern, at, target (from the root). path, pattern, at, target, origin, depth.

    A config has its own patterns and those of what it extends, step by step; of a pattern that several have, the nearest's
    targets count, all of them. Only relative names (./, ../) of configs that are there are followed, with .json added where it
    is missing; circles end. Each round looks twice as far along the chains as the one before.
    """
    there = written(configs.select("path", "extends").dropDuplicates(["path"]), "configs")
    name = resolved(F.col("path"), F.col("extends"))
    name = F.when(name.endswith(".json"), name).otherwise(F.concat(name, F.lit(".json")))
    up = there.where("startswith(extends, './') OR startswith(extends, '../')").select("path", name.alias("to"))
    jumps = written(up.join(apart(there.select(F.col("path").alias("to"))), "to", "left_semi").where("path <> to").select("path", "to", F.lit(1).cast("long").alias("far")), "extends")
    have = written(aliases.select("path", "pattern").distinct().join(apart(there), "path", "left_semi").select("path", "pattern", F.col("path").alias("origin"), F.lit(0).cast("long").alias("depth")), "patterns")
    most, far = there.count(), 1
    while far <= most and not jumps.isEmpty():
        pulled = jumps.join(apart(have.withColumnRenamed("path", "to")), "to").select("path", "pattern", "origin", (F.col("depth") + F.col("far")).alias("depth"))
        nearest = have.unionByName(pulled).groupBy("path", "pattern").agg(F.min(F.struct("depth", "origin")).alias("x"))
        have = written(nearest.select("path", "pattern", F.col("x.origin").alias("origin"), F.col("x.depth").alias("depth")), "patterns")
        on = jumps.select(F.col("path").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        jumps = written(jumps.join(apart(on), "to").select("path", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far")), "extends")
        far *= 2
    targets = aliases.select(F.col("path").alias("origin"), "pattern", "at", "target")
    return have.join(apart(targets), ["origin", "pattern"]).select("path", "pattern", "at", "target", "origin", "depth")
