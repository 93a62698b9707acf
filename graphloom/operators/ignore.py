"""Ignore files: which paths of a repository their rules leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ignore_rules(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """files: path, content. folder, line, regex (over the path from the folder), negated, only_folders of the rules in ignore files.

    Blank lines and comments are none. ! takes back, a / at the end means folders only, a / elsewhere binds the rule to its folder;
    * and ? stop at a /, ** does not, [..] is a class, a backslash takes a character as it is.
    """
    own = files.where((F.col("path") == name) | F.col("path").endswith("/" + name)).where("content IS NOT NULL")
    folder = F.regexp_replace(F.substring("path", F.lit(1), F.length("path") - len(name)), "/$", "")
    rows = own.select(folder.alias("folder"), F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    text = F.regexp_replace("text", r"(?<!\\)\s+$", "")
    rows = rows.select("folder", "line", text.alias("text")).where("text <> '' AND NOT startswith(text, '#')")
    negated = F.col("text").startswith("!")
    rows = rows.select("folder", "line", negated.alias("negated"), F.when(negated, F.expr("substring(text, 2)")).otherwise(F.col("text")).alias("text"))
    only = F.col("text").endswith("/")
    rows = rows.select("folder", "line", "negated", only.alias("only_folders"), F.regexp_replace("text", "/+$", "").alias("text")).where("text <> ''")
    bound = F.instr(F.col("text"), "/") > 0
    return rows.select("folder", "line", F.concat(F.when(bound, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), _regex(F.regexp_replace("text", "^/", "")), F.lit("$")).alias("regex"), "negated", "only_folders")


#: In the order in which they are looked for: a glob's part, and what it becomes. Until the rest is quoted, a character of the
#: private area stands for each.
_PARTS = ((r"^\*\*/", "(?:.*/)?"), (r"/\*\*/", "/(?:.*/)?"), (r"/\*\*$", "/.+"), (r"\*+", "[^/]*"), (r"\?", "[^/]"))
_HELD = 0xE000


def _regex(glob: Column) -> Column:
    """A glob as a regular expression."""
    out = glob
    for k, (pattern, _) in enumerate(_PARTS):
        out = F.regexp_replace(out, r"(?<!\\)" + pattern, chr(_HELD + k))
    out = F.regexp_replace(out, r"(?<!\\)\[!?([^\]]+)\]", chr(_HELD + 20) + "$1" + chr(_HELD + 21))
    negated = F.regexp_replace(glob, r"\\.", "").contains("[!")
    out = F.regexp_replace(out, r"\\(.)", "$1")
    out = F.regexp_replace(out, r"([.+(){}|$^*?\[\]\\])", r"\\$1")
    for k, (_, meaning) in enumerate(_PARTS):
        out = F.replace(out, F.lit(chr(_HELD + k)), F.lit(meaning))
    out = F.replace(out, F.lit(chr(_HELD + 20)), F.when(negated, "[^").otherwise("["))
    return F.replace(out, F.lit(chr(_HELD + 21)), F.lit("]"))


def rules_by_folder(rules: DataFrame) -> DataFrame:
    """folder, rules: its different rules in order of their lines; the same rule of several files is one."""
    return rules.groupBy("folder").agg(F.array_sort(F.collect_set(F.struct("line", "regex", "negated", "only_folders"))).alias("rules"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths: path of files. rules as of ignore_rules(). path, ignored.

    A path is left out if it, or a folder on its way, is: by the last rule that fits in the deepest folder that has one. What
    lies in a folder that is left out can't be taken back. Folders are judged once each; rules meet what lies below their
    folder by an equi-join, and of a folder's different rules an array is kept, as long as its file; equal rules count once. Null paths are left out of the result.
    """
    files = paths.where("path IS NOT NULL").select("path").distinct()
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    laid = files.select("path", F.posexplode(prefixes).alias("depth", "entry"), F.size(parts).alias("parts"))
    entries = laid.select("entry", (F.col("depth") + 1 < F.col("parts")).alias("is_folder")).distinct()
    own = F.split("entry", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda k: F.array_join(F.slice(own, F.lit(1), k), "/"))
    by_folder = rules_by_folder(rules)
    met = entries.select("entry", "is_folder", F.posexplode(above).alias("depth", "folder")).join(by_folder, "folder")
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(folder) + 2)"))
    fits = F.filter("rules", lambda r: (F.col("is_folder") | ~r["only_folders"]) & F.regexp_like(below, r["regex"]))
    last = met.select("entry", "is_folder", "depth", fits.alias("fits")).where("size(fits) > 0")
    best = last.groupBy("entry", "is_folder").agg(F.max_by(F.element_at("fits", -1)["negated"], "depth").alias("negated"))
    out = best.where("NOT negated").select("entry", "is_folder")
    hit = laid.withColumn("is_folder", F.col("depth") + 1 < F.col("parts")).join(out, ["entry", "is_folder"], "left_semi").select("path").distinct()
    return files.join(hit.withColumn("ignored", F.lit(True)), "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))
