"""Type propagation against one file after the other in plain Python."""

import random

import pytest

from graphloom.operators import propagate, resolve


def order_of(files, arcs):
    """The files one after the other: the smallest that waits for nothing, else the smallest."""
    left, out = set(files), []
    while left:
        ready = [f for f in left if not any(n in left for n in arcs.get(f, ()))]
        out.append(min(ready or left))
        left.remove(out[-1])
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", range(3))
def test_visit_steps(spark, seed):
    rng = random.Random(seed)
    files = [f"f{k:02}" for k in range(24)]
    arcs = {f: {rng.choice(files[k // 8 * 8 : k // 8 * 8 + 8]) for _ in range(rng.choice((0, 1, 1, 2, 3)))} - {f} for k, f in enumerate(files)}
    rows = [(f, n) for f in files for n in arcs[f]] + [("f00", "gone"), ("f00", "f00"), (None, "f01"), ("f01", None)]
    steps = {r.file: r.step for r in propagate.visit_steps(frame(spark, [(f,) for f in files], "file string"), frame(spark, rows, "file string, needs string")).collect()}
    assert set(steps) == set(files)
    place = {f: k for k, f in enumerate(order_of(files, arcs))}
    for f in files:
        for n in arcs[f]:
            assert (steps[n] < steps[f]) == (place[n] < place[f]), (f, n)


def test_circles_of_two_end_by_path(spark):
    files = frame(spark, [("src/right.py",), ("src/left.py",)], "file string")
    steps = propagate.visit_steps(files, frame(spark, [("src/left.py", "src/right.py"), ("src/right.py", "src/left.py")], "file string, needs string"))
    assert {tuple(r) for r in steps.collect()} == {("src/left.py", 0), ("src/right.py", 1)}
    assert propagate.visit_steps(files.limit(0), frame(spark, [], "file string, needs string")).count() == 0


def by_hand(files, imports, classes, bindings, bases, methods, calls, steps):
    """Environments and calls of files in the order of their steps."""
    times = {}
    for c, f, n in classes:
        times.setdefault(c, []).append((f, n))
    known = {c: x[0] for c, x in times.items() if len(x) == 1}
    exported, envs, found_bases = {}, {}, []
    module = dict(files)
    for f in sorted(module, key=lambda f: steps[f]):
        env, imported = {}, {}
        for _, local, m, symbol in (r for r in imports if r[0] == f):
            hit = f"{m}::{symbol}" if f"{m}::{symbol}" in known else exported.get((m, symbol), (None, 99))[0] if exported.get((m, symbol), (None, 99))[1] < steps[f] else None
            if hit:
                imported.setdefault(local, set()).add(hit)
        env |= {k: next(iter(v)) for k, v in imported.items() if len(v) == 1}
        env |= {n: c for c, (g, n) in known.items() if g == f}

        def constructed(name, env=env):
            if name in env:
                return env[name]
            head, dot, rest = name.partition(".")
            if dot and head in env:
                c = env[head].rpartition("::")[0] + "::" + rest
                return c if c in known else None
            return None

        bound = {}
        for _, name, maker, _ in (r for r in bindings if r[0] == f):
            bound.setdefault(name, set()).add(constructed(maker))
        env |= {k: next(iter(v)) for k, v in bound.items() if len(v) == 1 and None not in v}
        envs[f] = env
        found_bases += [(child, env[maker], place, f) for g, child, maker, place in bases if g == f and maker in env]
        for _, name, _, out in (r for r in bindings if r[0] == f):
            if out and name in env:
                exported[module[f], name] = (env[name], steps[f])
    has, out = set(methods), []
    for i, f, receiver, cls, method in calls:
        start = envs[f].get(receiver) if receiver else cls
        if not start:
            continue
        queue, seen, owner = [(start, 0)], set(), (None, None)
        while queue:
            c, depth = queue.pop(0)
            if c in seen:
                continue
            seen.add(c)
            if (c, method) in has:
                owner = (c, depth)
                break
            nearest = {}
            for child, base, place, g in found_bases:
                if child == c and (g == f or steps[g] < steps[f]):
                    nearest[base] = min(place, nearest.get(base, 99))
            queue += [(b, depth + 1) for b, _ in sorted(nearest.items(), key=lambda x: x[1])]
        out.append((i, f, start, method, *owner))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_propagated_calls(spark, seed):
    rng = random.Random(seed)
    names = [f"f{k:02}" for k in range(14)]
    files = [(f, f"m.{f}") for f in names]
    classes = [(f"m.{f}::{n}", f, n) for f in names for n in ("A", "B") if rng.random() < 0.6]
    classes += [(classes[0][0], names[5], "A")]  # twice: denotes nothing
    imports = [(f, rng.choice("xyzA"), f"m.{rng.choice(names)}", rng.choice(("A", "B", "o", "p"))) for f in names for _ in range(4)]
    bindings = [(f, rng.choice(("o", "p", "x")), rng.choice(("A", "B", "x", "y", "x.B", "nope")), rng.random() < 0.7) for f in names for _ in range(2)]
    bases = [(f, c, rng.choice("xyzAB"), k) for k, (c, f, _) in enumerate(classes)] + [(f, c, rng.choice("xyz"), k + 100) for k, (c, f, _) in enumerate(classes)]
    methods = [(c, m) for c, _, _ in classes for m in ("run", "stop", "go") if rng.random() < 0.3]
    calls = [(k, rng.choice(names), *rng.choice((("x", None), ("o", None), ("A", None), ("p", None), (None, rng.choice(classes)[0]))), rng.choice(("run", "stop", "go"))) for k in range(120)]
    tables = {
        "files": frame(spark, files, "file string, module string"), "imports": frame(spark, imports, "file string, local string, module string, symbol string"),
        "classes": frame(spark, classes, "class string, file string, name string"), "bindings": frame(spark, bindings, "file string, name string, constructor string, exported boolean"),
    }
    module = {m: f for f, m in files}
    steps = propagate.visit_steps(tables["files"], frame(spark, [(f, module[m]) for f, _, m, _ in imports], "file string, needs string"))
    env = propagate.environments(**tables, steps=steps)
    inherits = propagate.resolved_bases(frame(spark, bases, "file string, child string, constructor string, place int"), env, tables["classes"])
    found = propagate.propagated_calls(frame(spark, calls, "id int, file string, receiver string, class string, method string"), env, inherits, frame(spark, methods, "class string, method string"))
    order = {r.file: r.step for r in steps.collect()}
    assert sorted(map(tuple, found.collect()), key=repr) == by_hand(files, imports, classes, bindings, bases, methods, calls, order)


def test_inherited_from_far_up(spark):
    chain = frame(spark, [(f"C{k}", f"C{k + 1}") for k in range(25)] + [("C25", "C0")], "class string, base string")
    found = resolve.inherited_methods(frame(spark, [("C0",)], "class string"), chain, frame(spark, [("C22", "run"), ("C24", "run")], "class string, method string"))
    assert [tuple(r) for r in found.collect()] == [("C0", "run", "C22", 22)]
