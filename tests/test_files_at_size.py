"""Work over files is dealt over cores, equal rules count once, and lines laid out in words are not broadcast."""

from pyspark.sql import functions as F

from graphloom.operators import findings, ignore
from graphloom.sources.files import files, stack_files


def test_equal_rules_of_a_folder_count_once(spark):
    text = "*.md\n!keep.md"
    many = spark.range(50).select(F.lit("a/.gitignore").alias("path"), F.lit(text).alias("content"))
    rules = ignore.ignore_rules(many)
    assert [len(r.rules) for r in ignore.rules_by_folder(rules).collect()] == [2]
    paths = spark.createDataFrame([("a/x.md",), ("a/keep.md",), ("b/x.md",)], "path string")
    assert {r.path: r.ignored for r in ignore.ignored(paths, rules).collect()} == {"a/x.md": True, "a/keep.md": False, "b/x.md": False}


def test_lines_in_words_are_not_broadcast(spark, tmp_path):
    names = spark.createDataFrame([("/api/one",), ("/api/two",), ("/api/long/name",)], "route string")
    lines = spark.createDataFrame([("GET /API/one now",), ("/api/long/names",)], "text string")
    # as files: of those Spark knows the size, which does not tell how large the lines are in words
    for name, df in (("names", names), ("lines", lines)):
        df.write.parquet(f"{tmp_path}/{name}")
    names, lines = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("names", "lines"))
    found = findings.unmentioned(names, "route", lines)
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for k, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = []
            for other in plan[k + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            # a hit's names may go to all, which have a join of their own; laid out lines alone may not
            assert not any("Generate" in x for x in below) or any("Join" in x for x in below)
    assert [r.route for r in found.collect()] == ["/api/two"]


def test_files_are_dealt_over_cores(spark):
    for make in (files, stack_files):
        assert make(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_parts_of_a_task_are_bounded(spark, monkeypatch):
    from graphloom.sources import files as made

    monkeypatch.setattr(made, "PARTS", 10, raising=False)
    assert made.stack_files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 20
