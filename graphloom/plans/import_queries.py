"""Queries over modules that import each other: visit order, types carried along, member calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import propagate
from graphloom.plans.registry import query
from graphloom.sources.tables import table
from graphloom.storage import apart

#: Ten files to a package; a file imports up to three of its package, by its part's size, a few of them later ones, so that some are on circles.
IMPORTS = """files AS (SELECT p_partkey AS k, p_partkey // 10 AS g, 'm' || lpad(p_partkey::VARCHAR, 9, '0') AS file FROM part),
arcs AS (SELECT DISTINCT a.g, a.file, b.file AS needs FROM files AS a JOIN part ON p_partkey = a.k, range(1, 4) AS t(i), files AS b
  WHERE b.k = a.g * 10 + (a.k * i + p_size * i * i + i) % 10 AND (b.k < a.k OR b.k > a.k AND (a.k + i) % 5 = 0))"""


def imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """files: k, g, file; arcs: file, needs, i."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = lambda c: F.concat(F.lit("m"), F.lpad(c.cast("string"), 9, "0"))
    group = F.floor(k / 10)
    rows = part.select(k.alias("k"), group.alias("g"), name(k).alias("file"), "p_size", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    other = F.col("g") * 10 + (F.col("k") * F.col("i") + F.col("p_size") * F.col("i") * F.col("i") + F.col("i")) % 10
    arcs = rows.select("k", "g", "file", "i", other.alias("other")).where("other < k OR (other > k AND (k + i) % 5 = 0)").select("k", "g", "file", "i", "other", name(F.col("other")).alias("needs"))
    files = part.select(k.alias("k"), group.alias("g"), name(k).alias("file"))
    return files, arcs.join(apart(files.select(F.col("k").alias("other"))), "other")


@query(f"""WITH RECURSIVE {IMPORTS}, walk(g, gone, x) AS (
  SELECT DISTINCT g, []::VARCHAR[], NULL::VARCHAR FROM files
  UNION ALL
  SELECT g, list_append(gone, min(s).file), min(s).file FROM (
    SELECT w.g, w.gone, struct_pack(waits := coalesce(bool_or(NOT list_contains(w.gone, a.needs)), false), file := f.file) AS s
    FROM walk AS w JOIN files AS f ON f.g = w.g AND NOT list_contains(w.gone, f.file) LEFT JOIN arcs AS a ON a.file = f.file GROUP BY w.g, w.gone, f.file
  ) GROUP BY g, gone
), place AS (SELECT x AS file, len(gone) AS n FROM walk WHERE x IS NOT NULL)
SELECT a.file, a.needs, q.n < p.n AS before FROM arcs AS a JOIN place AS p ON p.file = a.file JOIN place AS q ON q.file = a.needs""")
def import_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each import whether the file that is imported comes first; the SQL takes one file after the other."""
    files, arcs = imports(spark, sf_dir)
    steps = propagate.visit_steps(files, arcs)
    first = steps.select(F.col("file").alias("needs"), F.col("step").alias("first"))
    return arcs.select("file", "needs").distinct().join(apart(steps), "file").join(apart(first), "needs").select("file", "needs", (F.col("first") < F.col("step")).alias("before"))


@query()
def propagated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on names that files import from each other, bound to classes of other files, with methods of their bases."""
    files, arcs = imports(spark, sf_dir)
    files = files.withColumn("module", F.concat(F.lit("src."), "file"))
    k, module = F.col("k"), F.concat(F.lit("src."), "needs")
    wanted = arcs.select("file", F.concat(F.lit("dep"), F.col("i").cast("string")).alias("local"), module.alias("module"), F.when(F.col("other") % 3 == 0, "Kind").otherwise("obj").alias("symbol"))
    own = files.where("k % 3 = 0").select(F.concat("module", F.lit("::Kind")).alias("class"), "file", F.lit("Kind").alias("name"), "k")
    maker = F.when(k % 3 == 0, "Kind").when(k % 3 == 1, "dep1").otherwise("dep2")
    bindings = files.select("file", F.lit("obj").alias("name"), maker.alias("constructor"), (k % 5 != 0).alias("exported"))
    named = own.select("file", F.col("class").alias("child"), F.explode(F.array(F.lit("dep1"), F.lit("dep2"))).alias("constructor")).withColumn("place", F.substring("constructor", 4, 1).cast("int"))
    methods = own.select("class", F.explode(F.when(k % 2 == 0, F.array(F.lit("run"), F.lit("stop"))).otherwise(F.array(F.lit("stop")))).alias("method"))
    calls = files.select("k", "file", F.explode(F.array(F.lit("obj"), F.lit("dep1"), F.lit("dep3"))).alias("receiver")).select(
        F.concat_ws(":", "file", "receiver").alias("id"), "file", "receiver", F.lit(None).cast("string").alias("class"), F.when(k % 2 == 0, "run").otherwise("stop").alias("method")
    )
    steps = propagate.visit_steps(files, arcs)
    env = propagate.environments(files, wanted, own, bindings, steps)
    return propagate.propagated_calls(calls, env, propagate.resolved_bases(named, env, own), methods)
