"""Queries over documents, lines, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import classify, paths, text
from graphloom.operators import findings, incremental, relational, search, similarity
from graphloom.plans.registry import query
from graphloom.sources.tables import document_lines, table

#: The tokenizer in SQL; {x} is the text.
TOKENS = "list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')), ' '), lambda w: w <> '')"
LINES = "lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL)"


@query(f"WITH t AS (SELECT item_id, unnest({TOKENS.format(x='text')}) AS token FROM benchmark) SELECT item_id, token, count(*) AS n FROM t GROUP BY ALL")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.identifier_tokens(F.col("text"))).alias("token"))
    return words.groupBy("item_id", "token").agg(F.count(F.lit(1)).alias("n"))


BM25 = f"""
WITH d AS (SELECT doc_id AS id, {TOKENS.format(x="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT id, len(w) AS len FROM d), g AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM s),
q AS (SELECT query, word, count(*) AS times FROM (SELECT item_id AS query, unnest({TOKENS.format(x="text")}) AS word FROM benchmark) GROUP BY ALL),
t AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
r AS (SELECT query, id, sum(times * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
      FROM t JOIN f USING (word) JOIN q USING (word) JOIN s USING (id), g GROUP BY ALL),
k AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM r WHERE score > 0)
"""


@query(BM25 + "SELECT query, rank::INTEGER AS rank, round(score, 4) AS score FROM k WHERE rank <= 10")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark passage: ranks and scores."""
    return bm25_top(spark, sf_dir).select("query", "rank", F.round("score", 4).alias("score"))


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"))


@query(f"""
WITH d AS (SELECT doc_id AS id, {TOKENS.format(x="coalesce(text, '')")} AS w, embedding::DOUBLE[] AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
a AS (SELECT doc_id AS query, array_to_string(string_split(coalesce(text, ''), ' ')[2:6], ' ') AS text, embedding::DOUBLE[] AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE doc_id % 20 = 0),
s AS (SELECT id, len(w) AS len FROM d), g AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM s),
q AS (SELECT query, word, count(*) AS times FROM (SELECT query, unnest({TOKENS.format(x="text")}) AS word FROM a) GROUP BY ALL),
t AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
r AS (SELECT query, id, sum(times * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM t JOIN f USING (word) JOIN q USING (word) JOIN s USING (id), g GROUP BY ALL),
x AS (SELECT query, id, score / max(score) OVER (PARTITION BY query) AS lexical FROM r),
p AS (SELECT a.query, d.id, coalesce(least(greatest(list_cosine_similarity(d.e, a.e), 0.0), 1.0), 0.0) AS vector, coalesce(lexical, 0.0) AS lexical FROM a CROSS JOIN d LEFT JOIN x ON x.query = a.query AND x.id = d.id WHERE lexical IS NOT NULL OR d.e IS NOT NULL AND a.e IS NOT NULL),
k AS (SELECT *, 0.6 * vector + 0.4 * lexical AS score, row_number() OVER (PARTITION BY query ORDER BY round(0.6 * vector + 0.4 * lexical, 9) DESC, id) AS rank FROM p)
SELECT query, rank::INTEGER AS rank, round(score, 5) AS score FROM k WHERE rank <= 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each whose id 20 divides, by its vector and five of its words."""
    docs, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    rows = docs.join(v, "doc_id", "left")
    words = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 2, 5), " ")
    asked = rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), words.alias("text"), "vector")
    return search.hybrid_search(rows.select(F.col("doc_id").alias("id"), "text", "vector"), asked).select("query", "rank", F.round("score", 5).alias("score"))


SETS = f"sets AS (SELECT doc_id || ':' || line AS id, lang, list_distinct(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: strlen(w) > 1)) AS raw FROM ({LINES[10:-1]})), s AS (SELECT id, lang, list_sort(list_distinct(list_transform(raw, lambda w: lower(w)))) AS w FROM sets WHERE len(raw) > 0)"


def line_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word: id, lang, tokens."""
    lines = document_lines(spark, sf_dir)
    raw = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.octet_length(w) > 1))
    rows = lines.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string")).alias("id"), "lang", raw.alias("raw")).where(F.size("raw") > 0)
    return rows.select("id", "lang", F.array_distinct(F.transform("raw", lambda w: F.lower(w))).alias("tokens"))


@query(f"WITH {SETS}, c AS (SELECT lang, w, min(id) AS id FROM s GROUP BY ALL), t AS (SELECT lang, id, len(w) AS n, unnest(w) AS word FROM c), p AS (SELECT a.lang, a.id AS id_a, b.id AS id_b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.lang = b.lang AND a.word = b.word AND a.id < b.id GROUP BY ALL) SELECT lang, id_a, id_b, shared, round(shared / (na + nb - shared), 6) AS similarity FROM p WHERE shared / (na + nb - shared) >= 0.6")
def near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different line classes of one language with Jaccard 0.6 or more."""
    return similarity.near_pairs(line_sets(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {SETS} SELECT lang, id, min(id) OVER (PARTITION BY lang, w) AS class FROM s")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which class of equal word sets each line belongs to."""
    return similarity.classes_of(line_sets(spark, sf_dir)).select("lang", "id", "class")


@query("WITH q AS (SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q), r AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM p) SELECT query, rank::INTEGER AS rank, round(score, 5) AS score FROM r WHERE rank <= 10")
def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every twentieth vector, against all."""
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return search.vector_top(vectors, queries).select("query", "rank", F.round("score", 5).alias("score"))


@query(f"WITH w AS (SELECT item_id AS id, md5(unnest({TOKENS.format(x='text')})) AS h FROM benchmark), b AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS bucket, CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s FROM w), g AS (SELECT id, bucket, sum(s)::BIGINT AS v FROM b GROUP BY ALL HAVING sum(s) <> 0) SELECT id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM g")
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return search.hashed_embedding(rows).select("id", "bucket", F.round("value", 6).alias("value"))


@query(f"WITH {LINES} SELECT doc_id, line, trim(text) AS snippet FROM lines WHERE contains(lower(text), 'token')")
def grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep(document_lines(spark, sf_dir), "token")


QUESTION = "what does the license say about permission and warranty"


@query(f"WITH {LINES}, h AS (SELECT doc_id, line, text, len(list_filter(['about', 'and', 'does', 'license', 'permission', 'say', 'the', 'warranty', 'what'], lambda w: contains(lower(text), w))) AS hits FROM lines) SELECT doc_id, line, text, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, line) AS k FROM h WHERE hits > 0) WHERE k = 1")
def best_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best line for a question."""
    return search.best_lines(document_lines(spark, sf_dir), QUESTION)


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return search.chunks(docs).select("id", "ordinal", "start", "stop", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("WITH n AS (SELECT DISTINCT p_type AS name FROM part) SELECT name, unnest(list_distinct(list_transform(range(1, length(name) - 1), lambda i: substr(name, i, 3)))) AS gram FROM n")
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    return names.select("name", F.explode(text.trigrams(F.col("name"))).alias("gram"))


# Spans over a document's lines: each run of lines between blank ones.
SPANS = f"{LINES}, numbered AS (SELECT doc_id, line, text, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM lines), spans AS (SELECT doc_id, min(line) AS first, max(line) AS last, doc_id || '#' || min(line) AS span_id FROM numbered GROUP BY doc_id, block UNION ALL SELECT doc_id, 1, max(line), doc_id || '#all' FROM lines GROUP BY doc_id), hits AS (SELECT doc_id, line, doc_id || '@' || line AS hit_id FROM lines WHERE contains(text, 'token'))"


def spans_and_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    lines = document_lines(spark, sf_dir)
    block = F.sum((F.trim("text") == "").cast("int")).over(Window.partitionBy("doc_id").orderBy("line"))
    named = lambda df, tail: df.withColumn("span_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), tail))
    blocks = named(lines.withColumn("block", block).groupBy("doc_id", "block").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("block"), F.col("first").cast("string"))
    whole = named(lines.groupBy("doc_id").agg(F.lit(1).cast("long").alias("first"), F.max("line").alias("last")), F.lit("all"))
    hits = lines.where(F.col("text").contains("token")).select("doc_id", "line", F.concat_ws("@", F.col("doc_id").cast("string"), F.col("line").cast("string")).alias("hit_id"))
    return blocks.unionByName(whole), hits


@query(f"WITH {SPANS} SELECT hit_id, span_id FROM hits JOIN spans USING (doc_id) WHERE line BETWEEN first AND last")
def stabbing_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans around each line that has a word."""
    spans, hits = spans_and_hits(spark, sf_dir)
    return relational.stabbing_join(hits, spans, "doc_id", "line", "first", "last").select("hit_id", "span_id")


@query(f"WITH {SPANS} SELECT doc_id, hit_id, arg_min(span_id, struct_pack(a := last - first, b := span_id)) AS span_id FROM hits JOIN spans USING (doc_id) WHERE line BETWEEN first AND last GROUP BY doc_id, hit_id")
def innermost_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, hits = spans_and_hits(spark, sf_dir)
    return relational.innermost_join(hits, spans, "doc_id", "line", "first", "last", "span_id", "hit_id")


@query(f"WITH {SPANS}, windows AS (SELECT DISTINCT doc_id, (line - 1) // 10 * 10 + 1 AS a, (line - 1) // 10 * 10 + 10 AS b FROM lines) SELECT doc_id, a, span_id FROM windows JOIN spans USING (doc_id) WHERE a <= last AND first <= b")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which spans share a line with each window of ten lines."""
    spans, _ = spans_and_hits(spark, sf_dir)
    start = F.call_function("div", F.col("line") - 1, F.lit(10)) * 10
    windows = document_lines(spark, sf_dir).select("doc_id", (start + 1).alias("a"), (start + 10).alias("b")).distinct()
    return relational.overlap_join(windows, spans, "doc_id", ("a", "b"), ("first", "last")).select("doc_id", "a", "span_id")


@query("WITH q AS (SELECT 'customer:' || c_custkey AS id, string_split(c_name, '#') AS p FROM customer) SELECT p[2] AS ref, min(id) AS id FROM q GROUP BY p[2] HAVING count(DISTINCT id) = 1")
def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the last part of their name."""
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("qualified"))
    refs = names.select(F.element_at(F.split("qualified", "#"), -1).alias("ref")).distinct()
    return relational.suffix_match(refs, names, "ref", "qualified", "id", "#").select("ref", "id")


@query("WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages), u AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url), p AS (SELECT regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) AS path, min(page_id) AS page_id FROM pages GROUP BY 1), l AS (SELECT regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) AS path, min(page_id) AS page_id FROM pages GROUP BY 1) SELECT href, coalesce(u.page_id, p.page_id, l.page_id) AS page_id, CASE WHEN u.page_id IS NOT NULL THEN 'url' WHEN p.page_id IS NOT NULL THEN 'path' WHEN l.page_id IS NOT NULL THEN 'folder' ELSE 'unresolved' END AS strategy FROM r LEFT JOIN u ON u.url = href LEFT JOIN p ON p.path = href LEFT JOIN l ON l.path = href || '/'")
def first_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each href names: a page's URL, else its path, else its path with a slash."""
    pages = table(spark, sf_dir, "pages")
    refs = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    path = F.regexp_extract("url", r"^[^/]*//[^/?#]*([^?#]*)", 1)
    by = lambda c: pages.groupBy(c.alias("href")).agg(F.min("page_id").alias("page_id"))
    folder = by(path).where("endswith(href, '/')").select(F.expr("left(href, length(href) - 1)").alias("href"), "page_id")
    return relational.first_resolved(refs, "href", [("url", by(F.col("url"))), ("path", by(path)), ("folder", folder)], "page_id")


ALIASES = "list_distinct([x, upper(array_to_string(w, '_')), array_to_string(w, '_'), array_to_string(w, '-'), array_to_string(w, '.'), array_to_string(w, '')])"


@query(f"WITH a AS (SELECT DISTINCT upper(replace(p_brand, '#', '_')) AS env FROM part), b AS (SELECT DISTINCT p_brand AS conf FROM part), aw AS (SELECT env, env AS x, list_filter(regexp_split_to_array(lower(regexp_replace(env, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM a), bw AS (SELECT conf, conf AS x, list_filter(regexp_split_to_array(lower(regexp_replace(conf, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM b), l AS (SELECT env, unnest({ALIASES}) AS alias FROM aw), r AS (SELECT conf, unnest({ALIASES}) AS alias FROM bw) SELECT env, count(DISTINCT conf) AS n_candidates, min(conf) AS conf FROM l JOIN r USING (alias) GROUP BY env")
def alias_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper-case names linked to the brands they are spellings of."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    left = brands.select(F.upper(F.translate("name", "#", "_")).alias("name")).distinct()
    return relational.alias_links(left.withColumn("env", F.col("name")), brands.withColumn("conf", F.col("name")), "name", "env", "conf")


@query("SELECT doc_id, md5(regexp_replace(text, '(?i)(password|passwd|secret|token|api_key|apikey|access_key|private_key|credential)(\\s*[:=]\\s*[\"'']?)[^\\s\"'']+', '\\1\\2***', 'g')) AS digest FROM documents")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(findings.redact(F.col("text")).cast("binary")).alias("digest"))


@query("WITH g AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '# GENERATED BY the protocol buffer compiler.' || chr(10) WHEN 1 THEN repeat('ü', 1020) || '@generated' WHEN 2 THEN repeat('ü', 1018) || '@generated' WHEN 3 THEN 'revision = 1' || chr(10) || 'down_revision = 0' || chr(10) || 'def upgrade(): pass' ELSE '' END || coalesce(text, '') AS text, doc_id % 5 AS r FROM documents) SELECT doc_id, r IN (0, 3) OR regexp_matches(lower(substr(CASE WHEN r = 1 THEN '' ELSE text END, 1, CASE WHEN r = 2 THEN 1030 ELSE 2048 END)), 'do not edit|do not modify|@generated|code generated by|autogenerated|auto-generated|this file was automatically generated') AS generated FROM g")
def generated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers in the first 2,048 bytes; before the text stands what some generators write."""
    r = F.col("doc_id") % 5
    wide = lambda n: F.concat(F.repeat(F.lit("ü"), F.lit(n)), F.lit("@generated"))
    before = F.when(r == 0, "# GENERATED BY the protocol buffer compiler.\n").when(r == 1, wide(1020)).when(r == 2, wide(1018)).when(r == 3, "revision = 1\ndown_revision = 0\ndef upgrade(): pass").otherwise("")
    text = F.concat(before, F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", classify.is_generated_text(text).alias("generated"))


@query(f"WITH {LINES}, f AS (SELECT doc_id, line, text, starts_with(trim(text), '```') AS fence, ' ' || lower(text) || ' ' AS low FROM lines), g AS (SELECT *, coalesce(sum(fence::INTEGER) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS inside FROM f) SELECT doc_id, line, CASE WHEN trim(text) = '' THEN 'Blank' WHEN fence OR inside = 1 THEN 'Fenced' WHEN regexp_matches(low, 'todo|planned|not yet|will eventually|roadmap') THEN 'Future' WHEN regexp_matches(low, ' should |best |prefer |recommended|easy |simple ') THEN 'Subjective' WHEN regexp_matches(text, '\\b(GET|POST|PUT|DELETE|PATCH) /') THEN 'Route' WHEN regexp_matches(text, '[A-Za-z0-9_]+/[A-Za-z0-9_/]+\\.[a-z]+') THEN 'Path' WHEN regexp_matches(text, '\\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\\b') THEN 'EnvVar' ELSE 'Statement' END AS claim FROM g")
def line_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.claims(document_lines(spark, sf_dir))


@query("WITH p AS (SELECT page_id, regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '[^/.][^/]*\\.([^/.]+)$', 1)) AS extension FROM p")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[^/]*//[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", paths.parent(path).alias("parent"), paths.basename(path).alias("name"), paths.extension(path).alias("extension"))


@query("WITH s AS (SELECT doc_id, source, greatest(1, (strlen(text) / 3.5)::DOUBLE) AS x FROM documents WHERE text IS NOT NULL) SELECT source, count(*) AS n, sum(ceil(x))::BIGINT AS tokens FROM s GROUP BY source")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    size = text.estimated_tokens(F.greatest(F.octet_length("text"), F.lit(3.5)))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("tokens"))


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, strlen(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, strlen(text)) AS i FROM conversations),
w AS (SELECT conv_id, turn, n, i, 0 AS bucket, n AS used FROM r WHERE i = 1 UNION ALL
  SELECT r.conv_id, r.turn, r.n, r.i, CASE WHEN used > 0 AND used + r.n > 600 THEN bucket + 1 ELSE bucket END, CASE WHEN used > 0 AND used + r.n > 600 THEN r.n ELSE used + r.n END FROM w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1)
SELECT conv_id, turn, bucket FROM w""")
def packed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation in buckets of 600 bytes, in order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("size"))
    return incremental.pack_in_order(turns, "conv_id", "turn", "size", 600)
