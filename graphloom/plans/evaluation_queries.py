"""Queries over labels and events: metrics, windows, feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import incremental, metrics, search
from graphloom.plans.registry import query
from graphloom.plans.text_queries import BM25, bm25_top
from graphloom.sources.tables import table
from graphloom.storage import written
from graphloom.streaming import events


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")


@query("WITH x AS (SELECT quality = 1 AS a, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn FROM x) SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1 ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END, 6) AS recall FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a text's length tells its quality."""
    found = metrics.confusion(_labelled(spark, sf_dir), F.col("n_chars") > 1000, F.col("quality") == 1)
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("WITH x AS (SELECT lang AS a, quality AS b FROM labels JOIN documents USING (doc_id)), n AS (SELECT a, b, count(*) AS n FROM x GROUP BY ALL), ij AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM n), i AS (SELECT sum(s * (s - 1) / 2) AS s FROM (SELECT sum(n) AS s FROM n GROUP BY a)), j AS (SELECT sum(s * (s - 1) / 2) AS s FROM (SELECT sum(n) AS s FROM n GROUP BY b)) SELECT round((ij.s - i.s * j.s / (t * (t - 1) / 2)) / ((i.s + j.s) / 2 - i.s * j.s / (t * (t - 1) / 2)), 9) AS ari FROM ij, i, j")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.adjusted_rand(_labelled(spark, sf_dir), "lang", "quality").select(F.round("ari", 9).alias("ari"))


@query("WITH x AS (SELECT lang AS a, quality AS b FROM labels JOIN documents USING (doc_id)), n AS (SELECT a, b, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT count(*)::DOUBLE AS t FROM x), i AS (SELECT a, sum(n) AS s FROM n GROUP BY a), j AS (SELECT b, sum(n) AS s FROM n GROUP BY b), m AS (SELECT sum(n / t * ln(n * t / (i.s * j.s))) AS m FROM n JOIN i USING (a) JOIN j USING (b), t), h AS (SELECT sum(-s / t * ln(s / t)) AS h FROM i, t), g AS (SELECT sum(-s / t * ln(s / t)) AS g FROM j, t) SELECT round(least(1, greatest(0, m / sqrt(h * g))), 9) AS nmi FROM m, h, g")
def normalised_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.normalised_information(_labelled(spark, sf_dir), "lang", "quality").select(F.round("nmi", 9).alias("nmi"))


@query("WITH m AS (SELECT event_type, median(value) AS median, count(value) AS n FROM events GROUP BY event_type) SELECT event_type, round(any_value(m.median), 6) AS median, round(median(abs(value - m.median)), 6) AS mad, any_value(n) AS n FROM events JOIN m USING (event_type) GROUP BY event_type")
def median_and_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.median_and_mad(table(spark, sf_dir, "events"), "event_type", "value")
    return found.withColumns({c: F.round(c, 6) for c in ("median", "mad")})


RELEVANT = ", rel AS (SELECT item_id AS query, doc_id AS id FROM documents JOIN benchmark b ON contains(documents.text, b.text))"


def _relevant(spark: SparkSession, sf_dir: str, block: int = 100_000) -> DataFrame:
    """Documents that hold a benchmark passage: query, id; written, as it is used twice.

    A word of a passage with a space on either side is a word of each document that holds it, so the longest one tells which
    documents are compared. Passages without one are compared to all documents. Blocks of passages are broadcast, one after the other.
    """
    words = F.split("text", " ")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage"), longest["w"].alias("word"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    own = docs.select("id", F.explode(F.array_distinct(words)).alias("word"))
    held = F.col("text").contains(F.col("passage"))
    found = []
    for some in search.blocks(items.where("word IS NOT NULL"), "query", block):
        near = written(own.join(F.broadcast(some.select("query", "word")), "word").select("query", "id").distinct(), "passage-words")
        found.append(docs.join(near, "id").join(F.broadcast(some.select("query", "passage")), "query").where(held).select("query", "id"))
    for some in search.blocks(items.where("word IS NULL"), "query", block):
        found.append(docs.join(F.broadcast(some), held).select("query", "id"))
    return written(reduce(DataFrame.unionByName, found), "relevant")


@query(BM25 + RELEVANT + ", i AS (SELECT query, least(count(*), 10) AS n FROM rel GROUP BY query)  , got AS (SELECT query, sum(1 / log2(rank + 1)) AS dcg FROM k JOIN rel USING (query, id) WHERE rank <= 10 GROUP BY query) SELECT query, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, n + 1), lambda r: 1 / log2(r + 1))), 6) AS ndcg FROM i LEFT JOIN got USING (query)")
def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well BM25 finds the documents that hold each passage."""
    return metrics.ndcg(bm25_top(spark, sf_dir), _relevant(spark, sf_dir)).select("query", F.round("ndcg", 6).alias("ndcg"))


@query(BM25 + RELEVANT + ", best AS (SELECT query, min(rank) AS rank FROM k JOIN rel USING (query, id) WHERE rank <= 10 GROUP BY query) SELECT round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM (SELECT DISTINCT query FROM rel) LEFT JOIN best USING (query)")
def mean_reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = _relevant(spark, sf_dir)
    first = bm25_top(spark, sf_dir).join(relevant, ["query", "id"]).groupBy("query").agg(F.min("rank").alias("rank"))
    return metrics.mean_reciprocal_rank(relevant.select("query").distinct().join(first, "query", "left")).select(F.round("mrr", 6).alias("mrr"))


@query("WITH a AS (SELECT event_type, median(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT event_type, median(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) SELECT event_type, round((b.v - a.v) / a.v, 6) AS increase, (b.v - a.v) / a.v <= 0.2 AS passed FROM a JOIN b USING (event_type) WHERE a.v <> 0")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    middle = lambda df: df.groupBy("event_type").agg(F.median("value").alias("v"))
    old, new = middle(rows.where("ts < '2024-01-15'")), middle(rows.where("ts >= '2024-01-15'"))
    budgets = rows.select("event_type").distinct().withColumn("most", F.lit(0.2))
    found = metrics.regression_gate(old, new, "event_type", "v", budgets)
    return found.select("event_type", F.round("increase", 6).alias("increase"), "passed")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("WITH w AS (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.windowed(table(spark, sf_dir, "events"), "2 hours", "1 hour").withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(table(spark, sf_dir, "events"), "6 hours").withColumn("total", F.round("total", 4))


@query("WITH e AS (SELECT user_id AS node, CASE event_type WHEN 'purchase' THEN 'useful' WHEN 'signup' THEN 'useful' WHEN 'error' THEN 'dead_end' ELSE 'corrected' END AS outcome, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events), w AS (SELECT *, 2592000000000::BIGINT // (2592000 + greatest(1706745600 - seconds, 0)) AS weight FROM e), s AS (SELECT node, count(*) FILTER (outcome = 'useful') AS useful, count(*) FILTER (outcome <> 'useful') AS negative, sum(CASE WHEN outcome = 'useful' THEN weight ELSE -weight END)::BIGINT AS score FROM w GROUP BY node) SELECT *, CASE WHEN useful > 0 AND negative > 0 THEN 'contested' WHEN useful >= 2 AND score > 0 THEN 'preferred' WHEN useful > 0 AND score > 0 THEN 'tentative' ELSE 'dead_end' END AS lesson FROM s")
def feedback_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type").isin("purchase", "signup"), "useful").when(F.col("event_type") == "error", "dead_end").otherwise("corrected")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), outcome.alias("outcome"), at.alias("recorded_at"))
    return incremental.lessons(rows, 1_706_745_600)


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT DISTINCT event_id FROM events)")
def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = table(spark, sf_dir, "events").unionByName(table(spark, sf_dir, "events"))
    return events.once(twice).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("WITH w AS (SELECT c_custkey AS id, md5(c_name) AS d FROM customer), s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN md5('old' || c_custkey) WHEN c_custkey % 11 = 0 THEN md5('Customer#' || c_custkey) ELSE md5(c_name) END AS d FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT -c_custkey, md5(c_name) FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 0) SELECT w.id, CASE WHEN s.d = w.d THEN 'Reuse' WHEN w.d IN (SELECT d FROM s) THEN 'Copy' ELSE 'Compute' END AS action FROM w LEFT JOIN s ON s.id = w.id UNION ALL SELECT id, 'Delete' FROM s WHERE id NOT IN (SELECT id FROM w)")
def reuse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store of digests needs to follow the customers."""
    rows = table(spark, sf_dir, "customer")
    key, md5 = F.col("c_custkey"), lambda c: F.md5(c.cast("binary"))
    wanted = rows.select(key.alias("id"), md5(F.col("c_name")).alias("d"))
    old = F.when(key % 7 == 0, md5(F.concat(F.lit("old"), key.cast("string")))).when(key % 11 == 0, md5(F.concat(F.lit("Customer#"), key.cast("string")))).otherwise(md5(F.col("c_name")))
    stored = rows.where(key % 5 != 0).select(key.alias("id"), old.alias("d"))
    renamed = rows.where((key % 5 == 0) & (key % 2 == 0)).select((-key).alias("id"), md5(F.col("c_name")).alias("d"))
    return incremental.reuse_plan(wanted, stored.unionByName(renamed), "id", "d")
