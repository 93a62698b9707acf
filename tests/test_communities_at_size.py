"""Label rounds join by sorting: no copies of labels go through the driver."""

from graphloom.operators import analytics


def test_rounds_without_copies_at_the_driver(spark, monkeypatch):
    plans, write = [], analytics.written
    monkeypatch.setattr(analytics, "written", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    edges = [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("x", "y", 1)]
    found = {r.id: r.community for r in analytics.communities(spark.createDataFrame(edges, "u string, v string, weight int"), 2).collect()}
    assert set(found) == {"a", "b", "c", "x", "y"} and len(plans) > 2
    assert not any("BroadcastHashJoin" in p for p in plans)
