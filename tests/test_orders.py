"""Sequential rules that are found in parallel: cuts by a budget, owners pushed on, aliases that configs extend."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import budget, owners, planning, resolve


def cut(sizes, most):
    out, part, used, some = [], 0, 0, False
    for n in sizes:
        if some and used + n > most:
            part, used = part + 1, 0
        used, some = used + n, True
        out.append(part)
    return out


@pytest.mark.parametrize("most", [0, 6, 100, 10**9])
def test_cut_by_budget(spark, most):
    rng = random.Random(most)
    rows = [(g, k, rng.choice((0, 1, 2, 3, 5, 7, 40, None))) for g, n in (("hot", 900), ("a", 1), ("b", 7), (None, 60)) for k in range(n)]
    found = budget.cut_by_budget(spark.createDataFrame(rows, "g string, k int, size long").repartition(5), "g", ["k"], "size", most).collect()
    wanted = set()
    for g in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == g)
        wanted |= {(g, k, n or 0, p) for (_, k, n), p in zip(mine, cut([n or 0 for _, _, n in mine], most))}
    assert {tuple(r) for r in found} == wanted and len(found) == len(rows)


def test_parts_keep_the_budget(spark):
    rows = spark.createDataFrame([("m", "a", 5), ("m", "b", 5), ("m", "c", 1), ("m", "d", 9)], "module string, path string, tokens int")
    assert sorted(tuple(r) for r in planning.parts_of(rows, "module", "path", "tokens", 6).collect()) == [("m", "a", 5, 0), ("m", "b", 5, 1), ("m", "c", 1, 1), ("m", "d", 9, 2)]
    assert planning.parts_of(rows.limit(0), "module", "path", "tokens").count() == 0


def pushed(modules, relations):
    owner = {m: m for m in modules}
    for _ in range(80):
        before = dict(owner)
        for source, target, kind, _ in relations:
            if kind == "BelongsToModule" and target in modules:
                owner[source] = target
            elif kind == "Contains" and source in owner:
                owner[target] = owner[source]
        if owner == before:
            break
    return owner


@pytest.mark.parametrize("seed", range(4))
def test_pushed_owners(spark, seed):
    rng = random.Random(seed)
    modules, others = [f"m{k}" for k in range(4)], [f"n{k:02}" for k in range(25)]
    rows = []
    for k in range(45):
        a, b = sorted(rng.sample(range(25), 2))
        rows.append((others[rng.randrange(25)], rng.choice([*modules, "gone"]), "BelongsToModule", k) if rng.random() < 0.25 else (others[a], others[b], "Contains", k))
    rows += [("m0", "n03", "Contains", 100), ("n03", "m1", "Contains", 101), ("x", "y", "Calls", 102), ("lost", "lost2", "Contains", 103)]
    frame = spark.createDataFrame([*rows, (None, "n01", "Contains", 200), ("n01", None, "Contains", 201)], "source string, target string, kind string, place int")
    found = owners.pushed_owners(spark.createDataFrame([(m,) for m in modules], "id string"), frame)
    assert {r.id: r.owner for r in found.collect()} == pushed(set(modules), rows)


def test_owners_on_a_circle(spark):
    rows = [("m", "a", "Contains", 1), ("a", "b", "Contains", 2), ("b", "m", "Contains", 3), ("c", "d", "Contains", 4), ("d", "c", "Contains", 5)]
    found = owners.pushed_owners(spark.createDataFrame([("m",)], "id string"), spark.createDataFrame(rows, "source string, target string, kind string, place int"))
    assert {r.id: r.owner for r in found.collect()} == {"m": "m", "a": "m", "b": "m"} == pushed({"m"}, rows)


def test_rounds_end_with_the_longest_chain(spark, monkeypatch):
    names, write = [], owners.written
    monkeypatch.setattr(owners, "written", lambda df, name: (names.append(name), write(df, name))[1])
    refs = [(0, "m", None), *((k, None, k - 1) for k in range(1, 5)), (5, None, 6), (6, None, 5), *((k, "x", None) for k in range(7, 300))]
    found = owners._followed(spark.createDataFrame(refs, ["n", "owner", "from"]).select(F.col("n"), "owner", F.col("from").cast("long").alias("from")))
    assert {r[0]: r.owner for r in found.collect()} == {**{k: "m" for k in range(5)}, 5: None, 6: None, **{k: "x" for k in range(7, 300)}}
    assert names.count("references") <= 5


def test_extended_aliases(spark):
    configs = [("a/tsconfig.json", "./base"), ("a/base.json", "../root.json"), ("root.json", "@pkg/base"), ("b/one.json", "./two.json"), ("b/two.json", "./one.json"), ("c/self.json", "./self.json"), ("d/x.json", "./none"), ("e/x.json", None)]
    aliases = [("a/tsconfig.json", "@x/*", 0, "a/x/*"), ("a/base.json", "@x/*", 0, "no"), ("a/base.json", "@y", 0, "y0"), ("a/base.json", "@y", 1, "y1"), ("root.json", "@y", 0, "no"), ("root.json", "@z", 0, "z"), ("b/two.json", "@t", 0, "t"), ("c/self.json", "@s", 0, "s"), ("gone.json", "@g", 0, "g")]
    found = resolve.extended_aliases(spark.createDataFrame(configs, "path string, extends string"), spark.createDataFrame(aliases, "path string, pattern string, at int, target string"))
    assert {tuple(r) for r in found.collect()} == {
        ("a/tsconfig.json", "@x/*", 0, "a/x/*", "a/tsconfig.json", 0), ("a/tsconfig.json", "@y", 0, "y0", "a/base.json", 1), ("a/tsconfig.json", "@y", 1, "y1", "a/base.json", 1), ("a/tsconfig.json", "@z", 0, "z", "root.json", 2),
        ("a/base.json", "@x/*", 0, "no", "a/base.json", 0), ("a/base.json", "@y", 0, "y0", "a/base.json", 0), ("a/base.json", "@y", 1, "y1", "a/base.json", 0), ("a/base.json", "@z", 0, "z", "root.json", 1),
        ("root.json", "@y", 0, "no", "root.json", 0), ("root.json", "@z", 0, "z", "root.json", 0), ("b/one.json", "@t", 0, "t", "b/two.json", 1), ("b/two.json", "@t", 0, "t", "b/two.json", 0), ("c/self.json", "@s", 0, "s", "c/self.json", 0),
    }


def test_aliases_are_joined_without_copies_at_the_driver(spark):
    found = resolve.extended_aliases(spark.createDataFrame([("a.json", None)], "path string, extends string"), spark.createDataFrame([("a.json", "@", 0, "t")], "path string, pattern string, at int, target string"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1
