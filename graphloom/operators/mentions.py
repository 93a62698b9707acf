"""What documents mention that the repository does not have: images, services, commands of task runners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import extract

#: Bytes around an inline token in which the word has to stand, the back-tick on that side among those behind it.
NEAR, WORD = 15, "service"
LONGEST_NAME = 32


def inline_tokens(documents: DataFrame) -> DataFrame:
    """documents: path, content. path, at, token, near: what stands between each two back-ticks, and whether "service" is near it.

    Back-ticks are paired from the start of a text; empty tokens and those over several lines are none. Of the text around only
    the last and first NEAR bytes of the parts beside a token are looked at, so a long text is not copied for each of its tokens.
    """
    rows = documents.where("content IS NOT NULL").select("path", F.posexplode(F.split("content", "`")).alias("at", "part"))
    raw = F.col("part").cast("binary")
    tail = F.lower(F.when(F.octet_length("part") > NEAR, F.substring(raw, -NEAR, NEAR)).otherwise(raw).cast("string"))
    head = F.lower(F.substring(raw, 1, NEAR).cast("string"))
    rows = rows.select("path", "at", "part", tail.alias("tail"), head.alias("head"), F.lead("at").over(Window.partitionBy("path").orderBy("at")).isNotNull().alias("closed"))
    by = Window.partitionBy("path").orderBy("at")
    # every part but the first has a back-tick before it, so NEAR parts have NEAR bytes at least
    before = F.array_join(F.collect_list("tail").over(by.rowsBetween(-NEAR, -1)), "`")
    after = F.array_join(F.collect_list("head").over(by.rowsBetween(1, NEAR)), "`")
    window = F.concat(F.substring(before.cast("binary"), -NEAR, NEAR).cast("string"), F.lit("`"), F.lower("part"), F.lit("`"), F.substring(after.cast("binary"), 1, NEAR - 1).cast("string"))
    found = rows.select("path", "at", F.col("part").alias("token"), window.contains(WORD).alias("near"), "closed")
    return found.where("at % 2 = 1 AND closed AND token <> '' AND NOT contains(token, chr(10))").drop("closed")


def stale_mentions(documents: DataFrame, images: DataFrame, services: DataFrame) -> DataFrame:
    """images: reference. services: name. path, rule, subject, actual: StaleImage, ContradictsCurrentFact (another tag of the image) or StaleService.

    A token is an image if it has a / and a :, no space, and is no address; of several tags of an image the smallest is named. It
    is a service if it is a short name near the word.
    """
    tokens = inline_tokens(documents)
    token = F.col("token")
    is_image = token.contains("/") & token.contains(":") & ~token.contains(" ") & ~token.startswith("http")
    without_tag = lambda c: F.regexp_replace(c, ":[^:]*$", "")
    known = images.select(F.col("reference").alias("token")).distinct()
    unknown = tokens.where(is_image).join(known, "token", "left_anti").withColumn("image", without_tag("token"))
    tags = images.groupBy(without_tag("reference").alias("image")).agg(F.min("reference").alias("actual"))
    rule = F.when(F.col("actual").isNull(), "StaleImage").otherwise("ContradictsCurrentFact")
    stale = unknown.join(tags, "image", "left").select("path", rule.alias("rule"), token.alias("subject"), "actual")
    named = tokens.where(~is_image & F.col("near") & token.rlike(f"^[A-Za-z0-9_-]{{1,{LONGEST_NAME}}}$"))
    gone = named.join(services.select(F.col("name").alias("token")).distinct(), "token", "left_anti")
    return stale.unionByName(gone.select("path", F.lit("StaleService").alias("rule"), token.alias("subject"), F.lit(None).cast("string").alias("actual")))


def runner_targets(files: DataFrame) -> DataFrame:
    """files: path, content. program (just, make, npm), target: recipes, goals and scripts that can be run."""
    name = F.element_at(F.split("path", "/"), -1)
    lines = extract.lines_of(files.where(name.isin("justfile", "Justfile", "Makefile"))).withColumn("program", F.when(name == "Makefile", "make").otherwise("just"))
    target = F.trim(F.regexp_extract("text", "^([^:]*):", 1))
    some = lines.where(~F.col("text").rlike(r"^\s") & ~F.col("text").startswith("#") & ((F.col("program") == "make") | ~F.col("text").startswith("set ")))
    listed = some.select("program", target.alias("target")).where(r"target <> '' AND NOT rlike(target, '\\s') AND (program = 'make' OR NOT endswith(target, '='))")
    scripts = files.where(name == "package.json").select(F.lit("npm").alias("program"), F.explode(F.json_object_keys(F.get_json_object("content", "$.scripts"))).alias("target"))
    return listed.unionByName(scripts).distinct()


def stale_commands(commands: DataFrame, targets: DataFrame) -> DataFrame:
    """commands: path, line, command. targets: program, target. path, line, command, program, target of what no file lets run.

    just and make name their target first, npm, pnpm and yarn behind "run"; other commands can't be checked and are left out.
    """
    words = F.split(F.trim("command"), r"\s+")
    first, second, third = (F.get(words, F.lit(k)) for k in range(3))
    program = F.when(first.isin("just", "make"), first).when(first.isin("npm", "pnpm", "yarn") & (second == "run"), "npm")
    asked = commands.select("path", "line", "command", program.alias("program"), F.when(program == "npm", third).otherwise(second).alias("target"))
    return asked.where("program IS NOT NULL AND target IS NOT NULL").join(targets, ["program", "target"], "left_anti").select("path", "line", "command", "program", "target")
