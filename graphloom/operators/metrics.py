"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """true_positive, false_positive, false_negative, precision, recall. With nothing predicted, precision is 1 only if nothing was missed."""
    counts = rows.agg(
        F.count_if(predicted & actual).alias("true_positive"), F.count_if(predicted & ~actual).alias("false_positive"), F.count_if(~predicted & actual).alias("false_negative")
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).when(fn == 0, 1.0).otherwise(0.0)
    return counts.withColumns({"precision": precision, "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)})


def mean_reciprocal_rank(ranks: DataFrame) -> DataFrame:
    """ranks: rank, null for none. mrr; 1 with no rows."""
    return ranks.agg(F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(1.0)).alias("mrr"))


def ndcg(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """results: query, id, rank. relevant: query, id. Of each query with a relevant row: query, ndcg at k."""
    gain = F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    got = results.where(F.col("rank") <= k).join(relevant, ["query", "id"]).groupBy("query").agg(gain)
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    ideal = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n")).select("query", best.alias("ideal"))
    return ideal.join(got, "query", "left").select("query", (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def _cells(rows: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return cells, cells.groupBy(a).agg(F.sum("n").alias("n")), cells.groupBy(b).agg(F.sum("n").alias("n"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """ari of two labelings; null for fewer than two rows, 1 where nothing can differ."""
    pairs = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))
    cells, left, right = _cells(rows, a, b)
    one = cells.agg(pairs("n").alias("ij"), F.sum("n").alias("total")).crossJoin(left.agg(pairs("n").alias("i"))).crossJoin(right.agg(pairs("n").alias("j")))
    expected = F.col("i") * F.col("j") / (F.col("total") * (F.col("total") - 1) / 2)
    most = (F.col("i") + F.col("j")) / 2
    return one.select(F.when(F.col("total") >= 2, F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected))).alias("ari"))


def normalised_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """nmi of two labelings with the geometric mean of their entropies; 1 where both are one class."""
    cells, left, right = _cells(rows, a, b)
    total = rows.agg(F.count(F.lit(1)).cast("double").alias("total"))
    joined = cells.join(left.withColumnRenamed("n", "x"), a).join(right.withColumnRenamed("n", "y"), b).crossJoin(total)
    shared = joined.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("x") * F.col("y")))).alias("shared"))
    entropy = lambda df, name: df.crossJoin(total).agg(F.sum(-F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total"))).alias(name))
    one = shared.crossJoin(entropy(left, "h")).crossJoin(entropy(right, "g"))
    norm = F.sqrt(F.col("h") * F.col("g"))
    return one.select(F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("shared") / norm))).otherwise(F.when((F.col("h") == 0) & (F.col("g") == 0), 1.0).otherwise(0.0)).alias("nmi"))


def median_and_mad(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, median, mad (the median distance from the median), n."""
    middle = rows.groupBy(by).agg(F.median(value).alias("median"), F.count(value).alias("n"))
    away = rows.join(middle, by).groupBy(by).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return middle.join(away, by).select(by, "median", "mad", "n")


def regression_gate(old: DataFrame, new: DataFrame, by: str, value: str, budgets: DataFrame) -> DataFrame:
    """budgets: by, most. by, increase, passed; from zero, any increase is one of 1."""
    joined = old.select(by, F.col(value).alias("_old")).join(new.select(by, F.col(value).alias("_new")), by).join(budgets, by)
    increase = F.when(F.col("_old") != 0, (F.col("_new") - F.col("_old")) / F.col("_old")).when(F.col("_new") > 0, 1.0).otherwise(0.0)
    return joined.select(by, increase.alias("increase"), (increase <= F.col("most")).alias("passed"))
