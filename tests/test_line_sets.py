"""Classes of equal sets: sets are made once, and rows without a language have their class, too."""

from pyspark.sql import functions as F

from graphloom.operators import similarity


def test_sets_are_made_once_and_null_languages_stay(spark):
    made = spark.sparkContext.accumulator(0)

    def tokens(n):
        made.add(1)
        return ["a", "b"] if n % 2 else ["c"]

    slow = F.udf(tokens, "array<string>")
    rows = spark.range(10).select(F.col("id"), F.when(F.col("id") < 6, "en").alias("lang"), slow("id").alias("tokens"))
    found = {r.id: (r.lang, r["class"]) for r in similarity.classes_of(rows).collect()}
    assert found == {k: ("en", k % 2) if k < 6 else (None, 6 + k % 2) for k in range(10)}
    assert made.value == 10
