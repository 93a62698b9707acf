"""Long jumps of a cut by a budget are made from rows where parts may begin only."""

import random

from graphloom.operators import budget


def test_long_jumps_are_few(spark, monkeypatch):
    counts, write = [], budget.written

    def written(df, name):
        out = write(df, name)
        if name == "jumps":
            counts.append(out.count())
        return out

    monkeypatch.setattr(budget, "written", written)
    rng = random.Random(1)
    rows = [("m", k, rng.randint(1, 9)) for k in range(400)]
    found = {r.k: r.part for r in budget.cut_by_budget(spark.createDataFrame(rows, "g string, k int, size long"), "g", ["k"], "size", 30).collect()}
    part, used = 0, 0
    for _, k, n in rows:
        part, used = (part + 1, n) if used + n > 30 else (part, used + n)
        assert found[k] == part
    assert counts[-1] == 0 and counts[-3] < 100
