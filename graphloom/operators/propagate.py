"""Types carried through imports: files in the order of what they import, environments from step to step, member calls.

A file comes after the files it imports. Where nothing is free any more, what is left has circles: in each connected part of it
the file with the smallest path is let through, as if what it still waits for were not there. Parts don't depend on each other,
so this is the order of one file after the other, in as many steps as the longest way has, at any size. Parts of bounded size are
dealt to tasks and ordered there; of larger ones no step holds more than the files that come in it, and each is a written table.
Joins are by sorting, so no copies of growing tables go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import components
from graphloom.operators.traverse import strong_components
from graphloom.storage import apart, discard, ship_package, written

#: Steps after which what is left is written anew.
REWRITE = 8
#: Imports that a connected part has at most that is ordered within a task.
MOST_ARCS = 2000


def visit_steps(files: DataFrame, imports: DataFrame, most: int = MOST_ARCS) -> DataFrame:
    """files: file. imports: file, needs. file, step (from 0): a file's step is after those of all it needs, but for circles.

    Imports of files that are not there and of a file itself don't count. There is no limit of steps. Steps of files that nothing
    connects are not comparable. Each connected part of `most` imports or fewer is ordered within a task, which has one such part
    at a time; larger ones are ordered together, in written steps.
    """
    here = files.select("file").where("file IS NOT NULL").distinct()
    arcs = imports.where("file <> needs").select("file", "needs").distinct()
    arcs = arcs.join(apart(here), "file", "left_semi").join(apart(here.select(F.col("file").alias("needs"))), "needs", "left_semi").select("file", "needs")
    arcs = written(arcs, "import-arcs")
    parts = components(arcs.select(F.col("file").alias("u"), F.col("needs").alias("v"))).select(F.col("node").alias("file"), "root")
    placed = written(arcs.join(apart(parts), "file"), "placed-arcs")
    large = written(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("root"), "large-parts")
    alone = here.join(apart(parts.select("file")), "file", "left_anti").select("file", F.lit(0).alias("step"))
    n = max(1, int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ship_package(arcs.sparkSession)
    small = placed.join(apart(large), "root", "left_anti").select("root", "file", "needs").repartition(n, "root").sortWithinPartitions("root")
    out = alone.unionByName(small.mapInArrow(_ordered_parts, f"file {arcs.schema['file'].dataType.simpleString()}, step int"))
    if not large.isEmpty():
        some = placed.join(apart(large), "root", "left_semi")
        out = out.unionByName(_steps_together(some.select(F.explode(F.array("file", "needs")).alias("file")).distinct(), some.select("file", "needs")))
    return written(out, "visit-steps")


def _ordered_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """root, file, needs, sorted by root: file, step, as visit_steps(), of each part by itself."""
    root, held, out, kind = None, [], [], None
    for batch in batches:
        kind = batch.column(1).type
        for r, file, needs in zip(*(c.to_pylist() for c in batch.columns)):
            if held and r != root:
                out += steps_of(held)
                held = []
            root = r
            held.append((file, needs))
        if len(out) >= 10_000:
            yield _step_rows(out, kind)
            out = []
    if held:
        yield _step_rows(out + steps_of(held), kind)


def _step_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int32())], names=["file", "step"])


def steps_of(arcs: list[tuple]) -> list[tuple]:
    """arcs: file, needs, distinct. file, step: in each step all that wait for nothing, else the smallest of each connected part."""
    waits, users = {}, {}
    for file, needs in arcs:
        waits.setdefault(file, set()).add(needs)
        waits.setdefault(needs, set())
        users.setdefault(needs, []).append(file)
    out, step, ready = [], 0, [f for f, w in waits.items() if not w]
    while waits:
        now, ready = ready or _least_of_parts(waits), []
        for file in now:
            del waits[file]
        for file in now:
            for user in users.get(file, ()):
                if user in waits:
                    waits[user].discard(file)
                    if not waits[user]:
                        ready.append(user)
        out += [(file, step) for file in now]
        step += 1
    return out


def _least_of_parts(waits: dict) -> list:
    """The smallest file of each connected part of what waits."""
    root = {f: f for f in waits}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for file, needs in waits.items():
        for other in needs:
            a, b = top(file), top(other)
            root[max(a, b)] = min(a, b)
    return [f for f in waits if root[f] == f]


def _steps_together(here: DataFrame, arcs: DataFrame) -> DataFrame:
    """here: file. arcs: file, needs. file, step of all parts at once: a step holds no more than the files that come in it."""
    arcs = written(arcs, "import-arcs")
    left, out, recent, step, forced, parts = written(here, "files-left"), [], [], 0, 0, None
    together = lambda tables: left.sparkSession.read.schema(tables[0].schema).parquet(*[x._written_at for x in tables])
    while True:
        now_left, now_arcs = left, arcs
        if recent:
            gone = together(recent).select("file")
            now_left, now_arcs = left.join(apart(gone), "file", "left_anti"), arcs.join(apart(gone.withColumnRenamed("file", "needs")), "needs", "left_anti")
        ready = now_left.join(apart(now_arcs.select("file").distinct()), "file", "left_anti")
        now = written(ready.select("file", F.lit(step).alias("step")), "files-released")
        if now.isEmpty():
            if now_left.isEmpty():
                break
            forced += 1
            # parts only fall apart as files come out, and older, coarser ones give the same order in more steps
            if forced & (forced - 1) == 0:
                waiting = now_arcs.join(apart(now_left), "file", "left_semi")
                parts = components(waiting.select(F.col("file").alias("u"), F.col("needs").alias("v"))).select(F.col("node").alias("file"), "root")
            least = parts.join(apart(now_left), "file", "left_semi").groupBy("root").agg(F.min("file").alias("file"))
            now = written(least.select("file", F.lit(step).alias("step")), "files-released")
        out.append(now)
        recent.append(now)
        step += 1
        if len(recent) == REWRITE:
            gone = together(recent).select("file")
            old_left, old_arcs = left, arcs
            left = written(left.join(apart(gone), "file", "left_anti"), "files-left")
            arcs = written(arcs.join(apart(gone), "file", "left_anti").join(apart(gone.withColumnRenamed("file", "needs")), "needs", "left_anti"), "import-arcs")
            discard(old_left)
            discard(old_arcs)
            recent = []
    return together(out) if out else here.select("file", F.lit(0).alias("step"))


def _one(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with exactly one different value (null counts as one); a null one is left out."""
    found = rows.groupBy(*keys).agg(F.min(value).alias(value), F.countDistinct(value).alias("_n"), F.max(F.col(value).isNull()).alias("_none"))
    return found.where("_n = 1 AND NOT _none").select(*keys, value)


def environments(files: DataFrame, imports: DataFrame, classes: DataFrame, bindings: DataFrame, steps: DataFrame) -> DataFrame:
    """file, name, class, step: what each name of a file denotes.

    files: file, module. imports: file, local, module, symbol. classes: class (module::Name), file, name; a class that is there
    twice denotes nothing. bindings: file, name, constructor, exported. A local name of an import denotes the class, or what the
    module has bound the symbol to, if that file came before; a class of the file hides it. Names with two answers have none. A
    binding's constructor is looked up among imports and classes; a dotted one (x.Name) in the module of what x denotes.
    """
    known = written(classes.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file"), F.min("name").alias("name")).where("n = 1").drop("n"), "classes")
    steps = written(steps.select("file", "step"), "steps")
    by_symbol = known.select(F.col("class"), F.col("class").alias("qualified"))
    wanted = imports.select("file", "local", "module", "symbol").distinct().join(apart(steps), "file").withColumn("qualified", F.concat_ws("::", "module", "symbol"))
    direct = written(wanted.join(apart(by_symbol), "qualified", "left").select("file", "step", "local", "module", "symbol", "class"), "direct-imports")
    bound = bindings.select("file", "name", "constructor", "exported").join(apart(steps), "file").join(apart(files.select("file", "module")), "file", "left")
    bound = written(bound, "bound")
    owned = written(known.join(apart(steps), "file").select("file", "name", "class", "step"), "own-classes")
    dots = not bound.where(F.col("constructor").contains(".")).isEmpty()
    last = steps.agg(F.max("step")).first()[0]
    together = lambda tables: steps.sparkSession.read.schema(tables[0].schema).parquet(*[x._written_at for x in tables])
    exported, out = [], []
    for step in range(0 if last is None else last + 1):
        mine = direct.where(F.col("step") == step)
        named = mine.where("class IS NOT NULL").select("file", F.col("local").alias("name"), "class")
        if exported:
            named = named.unionByName(mine.where("class IS NULL").drop("class").join(apart(together(exported)), ["module", "symbol"]).select("file", F.col("local").alias("name"), "class"))
        own = owned.where(F.col("step") == step).select("file", "name", "class")
        base = written(own.unionByName(_one(named, ["file", "name"], "class").join(apart(own), ["file", "name"], "left_anti")), "names")
        here = bound.where(F.col("step") == step)
        typed = here.join(apart(base.select("file", F.col("name").alias("constructor"), F.col("class").alias("whole"))), ["file", "constructor"], "left")
        if dots:
            head, rest = F.substring_index("constructor", ".", 1), F.expr("substring(constructor, instr(constructor, '.') + 1)")
            of_head = typed.withColumn("head", F.when(F.col("constructor").contains("."), head)).join(apart(base.select("file", F.col("name").alias("head"), F.col("class").alias("head_class"))), ["file", "head"], "left")
            module = F.expr("substring(head_class, 1, length(head_class) - length(substring_index(head_class, '::', -1)) - 2)")
            typed = of_head.withColumn("qualified", F.concat(module, F.lit("::"), rest)).join(apart(by_symbol.withColumnRenamed("class", "dotted")), "qualified", "left")
        found = F.coalesce("whole", "dotted") if dots else F.col("whole")
        typed = written(typed.select("file", "module", "name", "exported", found.alias("class")), "bindings")
        by_binding = _one(typed, ["file", "name"], "class")
        env = written(by_binding.unionByName(base.join(apart(by_binding), ["file", "name"], "left_anti")).select("file", "name", "class", F.lit(step).alias("step")), "environment")
        discard(base)
        out.append(env)
        if step < last:
            more = typed.where("exported AND module IS NOT NULL").select("file", "module", "name").distinct().join(apart(env), ["file", "name"])
            exported.append(written(more.select("module", F.col("name").alias("symbol"), "class"), "exported"))
        discard(typed)
    if not out:
        return classes.select("file", "name", "class", F.lit(0).alias("step")).limit(0)
    return together(out)


def resolved_bases(bases: DataFrame, env: DataFrame, classes: DataFrame) -> DataFrame:
    """bases: file, child, constructor, place. child, base, place, file, step: base classes named in a file, by its environment."""
    named = bases.join(apart(env.select("file", F.col("name").alias("constructor"), F.col("class").alias("base"), "step")), ["file", "constructor"])
    return named.join(apart(classes.select(F.col("class").alias("child")).distinct()), "child", "left_semi").select("child", "base", "place", "file", "step")


def propagated_calls(calls: DataFrame, env: DataFrame, inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """calls: id, file, receiver, class, method (class: of the call's receiver where it is the enclosing instance, then receiver is null).

    inherits: child, base, place, file, step (null step: known from the start). id, file, class, method, owner, depth: the class a
    call's receiver has and where its method is defined, the class itself first, then bases breadth first in the order of their
    places. A base that a file names counts for that file and for files of later steps. Receivers without a class give no row, and
    owner is null where no class has the method. Circles end, and no depth is too great.
    """
    named = calls.where("receiver IS NOT NULL").drop("class").join(apart(env.select("file", F.col("name").alias("receiver"), "class", "step")), ["file", "receiver"])
    steps = env.select("file", "step").distinct()
    own = calls.where("receiver IS NULL AND class IS NOT NULL").join(apart(steps), "file", "left")
    typed = written(named.select("id", "file", "class", "method", "step").unionByName(own.select("id", "file", "class", "method", "step")), "typed-calls")
    owners = breadth_first(typed.select("file", "step", "class", "method").distinct(), inherits, methods)
    return typed.join(apart(owners), ["file", "class", "method"], "left").select("id", "file", "class", "method", "owner", "depth")


def breadth_first(asked: DataFrame, inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """asked: file, step, class, method. file, class, method, owner, depth: the first class with the method, breadth first; as propagated_calls()."""
    arcs = written(inherits.groupBy("child", "base", "file", "step").agg(F.min("place").alias("place")), "bases")
    has = written(methods.select("class", "method").distinct(), "methods")
    at = written(asked.select("file", "step", "class", "method", F.col("class").alias("at"), F.array().cast("array<int>").alias("way")).distinct(), "asked")
    keys, depth, found, seen = ["file", "class", "method"], 0, None, at.select("file", "class", "method", "at")
    while not at.isEmpty():
        hit = at.join(apart(has.withColumnRenamed("class", "at")), ["at", "method"]).groupBy(*keys).agg(F.min_by("at", "way").alias("owner"))
        hit = written(hit.withColumn("depth", F.lit(depth)), "owners")
        found = hit if found is None else found.unionByName(hit)
        open_ = at.join(apart(hit.select(*keys)), keys, "left_anti")
        arc = arcs.select(F.col("child").alias("at"), "base", "place", F.col("file").alias("_file"), F.col("step").alias("_step"))
        seen_by = F.col("_step").isNull() | (F.col("_file") == F.col("file")) | (F.col("_step") < F.col("step"))
        up = open_.join(apart(arc), "at").where(seen_by).select("file", "step", "class", "method", F.col("base").alias("at"), F.concat("way", F.array("place")).alias("way"))
        up = up.groupBy("file", "step", "class", "method", "at").agg(F.min("way").alias("way")).join(apart(seen), [*keys, "at"], "left_anti")
        at = written(up, "ancestors")
        seen = seen.unionByName(at.select("file", "class", "method", "at"))
        depth += 1
    if found is None:
        return asked.select("file", "class", "method", F.lit(None).cast("string").alias("owner"), F.lit(0).alias("depth")).limit(0)
    return found.select(*keys, "owner", "depth")


def first_inherited(classes: DataFrame, inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """classes: class. inherits: class, base. methods: class, method. class, method, owner, depth: the nearest definition of each method.

    Of several at the same depth the smallest owner. Levels of ancestors are written one after the other until none is new.
    """
    bases = written(inherits.select("class", "base").distinct(), "bases")
    at = written(classes.select("class").distinct().select("class", F.col("class").alias("at"), F.lit(0).alias("depth")), "ancestors")
    levels = [at]
    while not at.isEmpty():
        seen = at.sparkSession.read.schema(at.schema).parquet(*[x._written_at for x in levels])
        up = at.join(bases.select(F.col("class").alias("at"), "base"), "at").select("class", F.col("base").alias("at")).distinct()
        at = written(up.join(seen.select("class", "at"), ["class", "at"], "left_anti").withColumn("depth", F.lit(len(levels))), "ancestors")
        levels.append(at)
    seen = at.sparkSession.read.schema(at.schema).parquet(*[x._written_at for x in levels])
    found = seen.join(methods.select(F.col("class").alias("at"), "method"), "at")
    return found.groupBy("class", "method").agg(F.min(F.struct("depth", "at")).alias("x")).select("class", "method", F.col("x.at").alias("owner"), F.col("x.depth").alias("depth"))


def layers(edges: DataFrame) -> DataFrame:
    """edges: source, target. id, layer: the longest way that ends at a node, circles counted as one node.

    Nodes on a circle are condensed first (traverse.strong_components); a layer is let through when all that is before
    it is, so there are as many rounds as layers and no limit of them.
    """
    arcs = written(edges.where("source <> target AND source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct(), "arcs")
    ids = arcs.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    root = written(ids.join(strong_components(arcs).select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("root")), "circles")
    named = lambda c: root.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    between = arcs.join(named("source"), "source").join(named("target"), "target").where("source_root <> target_root")
    left = written(between.select(F.col("source_root").alias("needs"), F.col("target_root").alias("file")).distinct(), "layer-arcs")
    steps = visit_steps(root.select(F.col("root").alias("file")).distinct(), left)
    return root.join(steps, F.col("root") == F.col("file")).select("id", F.col("step").alias("layer"))
