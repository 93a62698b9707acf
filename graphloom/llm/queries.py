"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import judge

    # which rule rejects first depends on measured costs, so the query leaves it out
    return judge(_table(spark, sf_dir, "documents")).drop("rejected_by", "n_lines")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT doc_id, count(DISTINCT i + o) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g), (VALUES (0), (1), (2)) AS v(o)
  WHERE c > 1 GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 5 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f
"""


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.simhash import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""


def op5_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ngram_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.packing import packed_documents

    return packed_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.bpe import encode_and_decode

    return encode_and_decode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.url_filter import BLOCKED_HOSTS, filter_urls, junk_hosts

    pages = _table(spark, sf_dir, "pages")
    listed = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "host string")
    return filter_urls(pages, blocked=junk_hosts(pages).unionByName(listed))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rule_host, rule_path, says) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), b(h) AS (
  SELECT host FROM u WHERE host <> '' GROUP BY host HAVING 2 * count(*) FILTER (regexp_matches(html, '%%%|###|\*\*\*|\$\$\$')) >= count(*)
  UNION ALL VALUES BLOCKED_HOSTS
), fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(says, length(rule_host || rule_path)) AS says
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT u.page_id, host, path, rule, coalesce(says, CASE WHEN EXISTS (
         SELECT 1 FROM b WHERE host = h OR ends_with(host, '.' || h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits ON fits.page_id = u.page_id
"""


def _op10_sql() -> str:
    from graphloom.llm.url_filter import BLOCKED_HOSTS

    return OP10_SQL.replace("BLOCKED_HOSTS", ", ".join(f"('{h}')" for h in BLOCKED_HOSTS))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.conversations import damaged, repair

    return repair(damaged(_table(spark, sf_dir, "conversations")))


#: The same repairs edit by edit: each step of the recursion takes one row and keeps the least (cost, audit) of each last role.
OP11_SQL = r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), bits AS (
  SELECT k, list_concat([4294967295::BIGINT], list_transform(range(8 * strlen(k)),
    lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(k, (i // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT)) AS b FROM (SELECT DISTINCT k FROM source)
), crc AS (
  SELECT k, xor(list_reduce(b, lambda x, y: CASE WHEN xor(x, y) % 2 = 1 THEN xor(xor(x, y) // 2, 3988292384) ELSE xor(x, y) // 2 END), 4294967295::BIGINT) % 20 AS kind FROM bits
), damage AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM source JOIN crc USING (k), (VALUES (1), (2)) AS copies(c) WHERE kind <> 0 AND (c = 1 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM damage
), faults AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ends_badly,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed
), known AS (
  SELECT conv_id, max(i) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (ends_badly AND NOT blank AND NOT duplicate) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), steps(f, t, between) AS (
  VALUES ('', 's', ''), ('', 'u', ''), ('', 'a', 'u'), ('s', 'u', ''), ('s', 'a', 'u'), ('u', 'a', ''), ('u', 'u', 'a'), ('a', 'u', ''), ('a', 'a', 'u')
), edits(f, t, between, e) AS (
  SELECT f, t, between, e FROM steps, (VALUES ('K'), ('R')) AS v(e) WHERE e = 'K' OR t <> 's'
  UNION ALL SELECT f, f, '', 'D' FROM (VALUES (''), ('s'), ('u'), ('a')) AS v(f)
), dp(conv_id, i, state, cost, audit, out) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', 0, '', ''::VARCHAR FROM source
  UNION ALL
  SELECT conv_id, i, t, cost, audit, out FROM (
    SELECT d.conv_id, r.i, t, d.cost + 3 * length(between) + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
             + CASE WHEN e <> 'D' AND ends_badly THEN 3 ELSE 0 END AS cost,
           d.audit || repeat('I', length(between)) || e AS audit,
           CASE e WHEN 'D' THEN d.out ELSE d.out || CASE between WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:' ELSE '' END || chr(10)
             || CASE WHEN e = 'K' THEN role WHEN t = 'u' THEN 'user' ELSE 'assistant' END || ':' || text END AS out
    FROM dp AS d JOIN faults AS r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1 JOIN edits ON f = d.state
    WHERE e = 'D' OR NOT blank AND NOT duplicate AND (e = 'R' OR substr(role, 1, 1) = t)
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY cost, audit) = 1
), ends AS (
  SELECT d.conv_id, cost + 3 * length(more) AS cost, audit || repeat('I', length(more)) AS audit,
         substr(out || CASE more WHEN 'a' THEN chr(10) || 'assistant:' WHEN 'ua' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END, 2) AS out
  FROM dp AS d LEFT JOIN known AS k ON k.conv_id IS NOT DISTINCT FROM d.conv_id
  JOIN (VALUES ('', ''), ('s', 'ua'), ('u', 'a'), ('a', '')) AS v(s, more) ON s = state WHERE d.i = coalesce(k.n, 0)
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(out) AS repaired_sha256
FROM ends AS e LEFT JOIN known AS k ON k.conv_id IS NOT DISTINCT FROM e.conv_id
QUALIFY row_number() OVER (PARTITION BY e.conv_id ORDER BY cost, audit) = 1
"""


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.personal_data import find_personal_data, summary

    return summary(find_personal_data(_table(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), l AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2)::HUGEINT // (any_value(total) + 2 * any_value(v)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM g GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), best AS (
  SELECT lang, source, term AS item, ((p.p - q) * (p.p - q) // (p.p + q))::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p.p > q
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM best
QUALIFY rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_ngram_scores": op5_ngram_scores,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_personal_data": op12_personal_data,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op10_url_filter": _op10_sql(),
    "op11_conversation_repair": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
