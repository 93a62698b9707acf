"""Visit orders of many packages: parts within tasks and large parts together give the same order; no copies go through the driver."""

import random

import pytest

from graphloom.operators import components, propagate
from test_propagate import order_of


@pytest.mark.parametrize("most", [2000, 6])
def test_parts_in_tasks_and_large_parts_together(spark, most):
    rng = random.Random(most)
    files = [f"f{k:02}" for k in range(18)]
    arcs = {f: {rng.choice(files[k // 6 * 6 : k // 6 * 6 + 6]) for _ in range(rng.choice((0, 1, 2, 3)))} - {f} for k, f in enumerate(files)}
    rows = [(f, n) for f in files for n in arcs[f]]
    found = propagate.visit_steps(spark.createDataFrame([(f,) for f in [*files, "alone"]], "file string"), spark.createDataFrame(rows, "file string, needs string"), most)
    steps = {r.file: r.step for r in found.collect()}
    assert set(steps) == {*files, "alone"} and steps["alone"] == 0
    place = {f: k for k, f in enumerate(order_of(files, arcs))}
    assert all((steps[n] < steps[f]) == (place[n] < place[f]) for f, n in rows)


def test_parts_are_ordered_without_written_steps(spark, monkeypatch):
    names, write = [], propagate.written
    monkeypatch.setattr(propagate, "written", lambda df, name: (names.append(name), write(df, name))[1])
    rows = [(f"f{k:03}", f"f{k - 1:03}") for k in range(1, 60)]
    found = propagate.visit_steps(spark.createDataFrame([(f"f{k:03}",) for k in range(60)], "file string"), spark.createDataFrame(rows, "file string, needs string"))
    assert {tuple(r) for r in found.collect()} == {(f"f{k:03}", k) for k in range(60)}
    assert len(names) < 8


def test_stars_are_joined_without_copies_at_the_driver(spark):
    links = spark.createDataFrame([(2, 1), (3, 2)], "u long, v long")
    for star in (components._large_star, components._small_star):
        assert "BroadcastHashJoin" not in star(links)._jdf.queryExecution().executedPlan().toString()


def test_calls_are_joined_without_copies_at_the_driver(spark):
    env = spark.createDataFrame([("f", "x", "m::A", 0)], "file string, name string, class string, step int")
    calls = spark.createDataFrame([(1, "f", "x", None, "run")], "id int, file string, receiver string, class string, method string")
    none = spark.createDataFrame([], "child string, base string, place int, file string, step int")
    found = propagate.propagated_calls(calls, env, none, spark.createDataFrame([("m::A", "run")], "class string, method string"))
    assert [tuple(r) for r in found.collect()] == [(1, "f", "m::A", "run", "m::A", 0)]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
