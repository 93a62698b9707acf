"""Lint of pages and claims, tags, explanations of settings, and the lab's comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import overlap_share, trigrams
from graphloom.operators import extract
from graphloom.operators.relational import aliases

# Sections of open questions, kinds of diagrams, least coverage of a module's page.
QUESTION_HEADINGS = ("unresolved questions", "open questions")
DIAGRAMS = ("graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram", "erDiagram", "gantt", "pie", "journey", "mindmap", "timeline", "gitGraph")
LEAST_COVERAGE = 0.5


def derived_tags(nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """nodes: id, path. layers: path, layer. entity_id, namespace, value: kind (the id's prefix), role:test, layer; each once."""
    kind = nodes.select(F.col("id").alias("entity_id"), F.lit("kind").alias("namespace"), F.substring_index("id", ":", 1).alias("value"))
    role = nodes.where(F.col("id").contains("test")).select(F.col("id").alias("entity_id"), F.lit("role").alias("namespace"), F.lit("test").alias("value"))
    layer = nodes.join(layers, "path").select(F.col("id").alias("entity_id"), F.lit("layer").alias("namespace"), F.lower("layer").alias("value"))
    return kind.unionByName(role).unionByName(layer).distinct()


def claim_fingerprints(claims: DataFrame) -> DataFrame:
    """claims: doc_id, line, claim, text. doc_id, line, claim, fingerprint: equal for the same claim in other white space and case."""
    plain = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    return claims.select("doc_id", "line", "claim", F.sha2(F.concat_ws(":", "claim", plain).cast("binary"), 256).alias("fingerprint"))


def diagram_findings(documents: DataFrame) -> DataFrame:
    """documents: path, content. path, line (of the fence), finding: empty, unknown_kind, unbalanced of mermaid fences."""
    rows = extract.fenced(extract.lines_of(documents))
    upto = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("begin", F.max(F.when(F.col("opens") & (F.col("language") == "mermaid"), F.col("line"))).over(upto))
    body = rows.where("inside AND language = 'mermaid'").groupBy("path", "begin").agg(F.min_by(F.trim("text"), F.when(F.trim("text") != "", F.col("line"))).alias("first"), F.array_join(F.collect_list("text"), "\n").alias("all"))
    opened = rows.where("opens AND language = 'mermaid'").select("path", F.col("line").alias("begin"))
    both = opened.join(body, ["path", "begin"], "left")
    known = F.coalesce(F.regexp_extract("first", r"^([A-Za-z]+)", 1), F.lit("")).isin(*DIAGRAMS)
    count = lambda c: F.length("all") - F.length(F.replace("all", F.lit(c), F.lit("")))
    unbalanced = (count("[") != count("]")) | (count("(") != count(")")) | (count("{") != count("}"))
    finding = F.when(F.coalesce(F.trim("all"), F.lit("")) == "", "empty").when(~known, "unknown_kind").when(unbalanced, "unbalanced")
    return both.select("path", F.col("begin").alias("line"), finding.alias("finding")).where("finding IS NOT NULL")


def safe_diagram_id(text: Column) -> Column:
    """A node's id that diagrams accept: letters, digits and underscores, not a digit first."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    return F.when(plain.rlike("^[0-9]") | (plain == ""), F.concat(F.lit("n_"), plain)).otherwise(plain)


def page_findings(pages: DataFrame, evidence: DataFrame, sources: DataFrame, modules: DataFrame) -> DataFrame:
    """pages: path, content. evidence: page, source, digest (when the page was made). sources: source, digest (now). modules: page, members, cited.

    path, finding, detail: PageWithoutEvidence, UnresolvedQuestions, EmptyMermaid, WeakModuleCoverage, MissingSourceLink,
    BrokenGeneratedDocLink, InvalidSourceRef, StaleEvidence.
    """
    row = lambda df, kind, path, detail: df.select(F.col(path).alias("path"), F.lit(kind).alias("finding"), detail.cast("string").alias("detail"))
    none = F.lit("")
    out = row(pages.join(evidence.select(F.col("page").alias("path")).distinct(), "path", "left_anti"), "PageWithoutEvidence", "path", none)
    asked = extract.headings(pages).where(F.lower("title").isin(*QUESTION_HEADINGS))
    out = out.unionByName(row(asked.select("path").distinct(), "UnresolvedQuestions", "path", none))
    out = out.unionByName(row(diagram_findings(pages).where("finding = 'empty'"), "EmptyMermaid", "path", F.col("line")))
    weak = modules.where(F.col("cited") < LEAST_COVERAGE * F.col("members"))
    out = out.unionByName(row(weak, "WeakModuleCoverage", "page", F.concat_ws("/", F.col("cited").cast("string"), F.col("members").cast("string"))))
    bare = extract.lines_of(pages).where(F.lower(F.ltrim("text")).rlike(r"^[-*]\s*source:") & ~F.col("text").rlike(r"\]\(|#L\d"))
    out = out.unionByName(row(bare, "MissingSourceLink", "path", F.col("line")))
    links = extract.links(pages).where("resolved IS NOT NULL AND resolved LIKE '%.md'")
    broken = links.join(pages.select(F.col("path").alias("resolved")), "resolved", "left_anti")
    out = out.unionByName(row(broken, "BrokenGeneratedDocLink", "path", F.col("target")))
    now = evidence.join(sources.select("source", F.col("digest").alias("now")), "source", "left")
    out = out.unionByName(row(now.where("now IS NULL"), "InvalidSourceRef", "page", F.col("source")))
    return out.unionByName(row(now.where("now <> digest"), "StaleEvidence", "page", F.col("source")))


def confidence_of(count: Column) -> Column:
    """30, 60 or 85 by how many there are: none or one, up to four, more."""
    return F.when(count <= 1, 30).when(count < 5, 60).otherwise(85)


def id_sections(nodes: DataFrame) -> DataFrame:
    """nodes: id, name. prefix, n, examples (three names by id) of each kind of id."""
    prefix = F.substring_index("id", ":", 1)
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("id"))
    rows = nodes.select("id", "name", prefix.alias("prefix"))
    few = rows.withColumn("k", rank).where("k <= 3").groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("examples"))
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).join(few, "prefix")


def setting_candidates(names: DataFrame, keys: DataFrame, best: int = 3) -> DataFrame:
    """names: env, path. keys: conf, path. env, conf, score, rank: the best keys of each name.

    min(300, 100 a shared word) + 250 times the share of shared trigrams + 150 for equal words joined, 100 if one contains the
    other, 50 for a shared first word + 100 for an acronym + 100 for the same file. Pairs share a word or a trigram: an equi-join.
    """
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: w != "")
    side = lambda df, name: df.select(F.col(name), F.col("path").alias(f"{name}_path"), F.array_distinct(words(F.col(name))).alias(f"{name}_w"), trigrams(F.array_join(words(F.col(name)), "")).alias(f"{name}_t"))
    a, b = side(names, "env"), side(keys, "conf")
    keyed = lambda df, name: df.select(name, F.explode(F.array_union(f"{name}_w", f"{name}_t")).alias("key"))
    pairs = keyed(a, "env").join(keyed(b, "conf"), "key").select("env", "conf").distinct()
    both = pairs.join(a, "env").join(b, "conf")
    plain = lambda n: F.array_join(f"{n}_w", "")
    shared = F.size(F.array_intersect("env_w", "conf_w"))
    contains = F.when(plain("env") == plain("conf"), 150).when(plain("env").contains(plain("conf")) | plain("conf").contains(plain("env")), 100).when(F.get("env_w", F.lit(0)) == F.get("conf_w", F.lit(0)), 50).otherwise(0)
    initials = lambda n: F.array_join(F.transform(f"{n}_w", lambda w: F.left(w, F.lit(1))), "")
    acronym = F.when(((F.size("conf_w") > 1) & (plain("env") == initials("conf"))) | ((F.size("env_w") > 1) & (plain("conf") == initials("env"))), 100).otherwise(0)
    score = F.least(F.lit(300), 100 * shared) + F.floor(250 * overlap_share(F.col("env_t"), F.col("conf_t"))) + contains + acronym + F.when(F.col("env_path") == F.col("conf_path"), 100).otherwise(0)
    scored = both.select("env", "conf", score.cast("long").alias("score"))
    rank = F.row_number().over(Window.partitionBy("env").orderBy(F.desc("score"), "conf"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= best)


def setting_explanations(names: DataFrame, uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """names: env. uses: env, user. definitions: conf, place. env, users, definitions (sorted), reason: linked, ambiguous, unused or undefined."""
    used = uses.groupBy("env").agg(F.array_sort(F.collect_set("user")).alias("users"))
    a = names.select("env", F.explode(aliases(F.col("env"))).alias("alias"))
    b = definitions.select("conf", "place", F.explode(aliases(F.col("conf"))).alias("alias"))
    found = a.join(b, "alias").groupBy("env").agg(F.array_sort(F.collect_set("place")).alias("definitions"), F.count_distinct("conf").alias("n"))
    none = F.array().cast("array<string>")
    out = names.join(used, "env", "left").join(found, "env", "left")
    reason = F.when(F.col("n") == 1, "linked").when(F.col("n") > 1, "ambiguous").when(F.col("users").isNull(), "unused").otherwise("undefined")
    return out.select("env", F.coalesce("users", none).alias("users"), F.coalesce("definitions", none).alias("definitions"), reason.alias("reason"))


def baseline_difference(old: DataFrame, new: DataFrame, stages: list[str]) -> DataFrame:
    """old, new: stage, key, value. stage, added, removed, changed of stages that differ, and first: whether it is the first in order."""
    a, b = old.withColumnRenamed("value", "old"), new.withColumnRenamed("value", "new")
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), ["stage", "key"], "full_outer")
    counts = both.groupBy("stage").agg(F.count_if(F.col("in_a").isNull()).alias("added"), F.count_if(F.col("in_b").isNull()).alias("removed"), F.count_if(F.col("in_a") & F.col("in_b") & ~F.col("old").eqNullSafe(F.col("new"))).alias("changed"))
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    differ = counts.where("added + removed + changed > 0").withColumn("at", order)
    least = differ.agg(F.min("at").alias("least"))
    return differ.crossJoin(F.broadcast(least)).select("stage", "added", "removed", "changed", (F.col("at") == F.col("least")).alias("first"))


def known_failures(observed: DataFrame, known: DataFrame, today: str) -> DataFrame:
    """observed: case, signature (a row for each issue). known: case, signature, n, expires. case, state: accepted, expired, changed or unknown.

    A case is accepted if every signature occurs just as often as it is known to, and none is past its day.
    """
    seen = observed.groupBy("case", "signature").agg(F.count(F.lit(1)).alias("seen"))
    both = seen.join(known, ["case", "signature"], "full_outer").join(known.select("case").distinct().withColumn("listed", F.lit(True)), "case", "left")
    same = F.col("seen").eqNullSafe(F.col("n"))
    by = both.groupBy("case").agg(F.bool_and(same).alias("same"), F.coalesce(F.bool_or(F.col("expires") < today), F.lit(False)).alias("late"), F.max("listed").alias("listed"))
    state = F.when(F.col("listed").isNull(), "unknown").when(F.col("late"), "expired").when(F.col("same"), "accepted").otherwise("changed")
    return by.select("case", state.alias("state"))


def audit_questions(leaders: DataFrame, bridges: DataFrame, gaps: DataFrame, most: int = 10) -> DataFrame:
    """leaders, bridges, gaps: name, rank (from 1). position, question: of the first three of each, and one about the whole."""
    ask = lambda df, text, k: df.where("rank <= 3").select((F.lit(k * 10) + F.col("rank")).alias("o"), F.concat(F.lit(text[0]), "name", F.lit(text[1])).alias("question"))
    every = ask(leaders, ("Why do so many things depend on ", "?"), 1).unionByName(ask(bridges, ("What would break without ", "?"), 2)).unionByName(ask(gaps, ("What should ", " resolve to?"), 3))
    last = leaders.sparkSession.range(1).select(F.lit(99).alias("o"), F.lit("Which parts have no evidence at all?").alias("question"))
    place = F.row_number().over(Window.orderBy("o"))  # ten rows
    return every.unionByName(last).select(place.alias("position"), "question").where(F.col("position") <= most)


def expectations(rules: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rules: rule, kind, a, b. rule, holds. Kinds: NodeExists, NodeAbsent, EdgeExists, EdgeAbsent (a to b), MinimumDegree (a, b a number),
    NoDangling, SameLabel (a and b)."""
    there = nodes.select(F.col("id").alias("a"), F.col("label").alias("la"))
    other = nodes.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    linked = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct().withColumn("linked", F.lit(True))
    degree = edges.select(F.explode(F.array("source", "target")).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    ids = nodes.select("id")
    loose = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select("id").unionByName(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select("id"))
    loose = loose.agg(F.count(F.lit(1)).alias("loose"))
    rows = rules.join(there, "a", "left").join(other, "b", "left").join(linked, ["a", "b"], "left").join(degree, "a", "left").crossJoin(F.broadcast(loose))
    kind = F.col("kind")
    holds = (
        F.when(kind == "NodeExists", F.col("la").isNotNull()).when(kind == "NodeAbsent", F.col("la").isNull()).when(kind == "EdgeExists", F.col("linked").isNotNull())
        .when(kind == "EdgeAbsent", F.col("linked").isNull()).when(kind == "MinimumDegree", F.coalesce("degree", F.lit(0)) >= F.expr("try_cast(b AS long)"))
        .when(kind == "NoDangling", F.col("loose") == 0).when(kind == "SameLabel", F.col("la") == F.col("lb"))
    )
    return rows.select("rule", F.coalesce(holds, F.lit(False)).alias("holds"))


def pair_accuracy(labels: DataFrame) -> DataFrame:
    """labels: id, a, b (two groupings). pairs, agreeing, accuracy: of all pairs, those that both put together or both apart.

    By counts of the contingency table, so pairs are never laid out.
    """
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.coalesce(two("n"), F.lit(0.0)).alias(f"t_{c}"))
    both = cells.agg(F.coalesce(two("n"), F.lit(0.0)).alias("t"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("all")).crossJoin(by("a")).crossJoin(by("b"))
    pairs = F.col("all") * (F.col("all") - 1) / 2
    agreeing = pairs + 2 * F.col("t") - F.col("t_a") - F.col("t_b")
    return both.select(pairs.alias("pairs"), agreeing.alias("agreeing"), F.when(pairs > 0, agreeing / pairs).otherwise(1.0).alias("accuracy"))


def over_budget(runs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """runs: run and a column for each limit. run, measure, value, budget where a value is over its limit."""
    rows = runs.select("run", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("budget")) for k, v in limits.items()])).alias("x"))
    return rows.select("run", "x.*").where("value > budget")


def run_metrics(runs: DataFrame) -> DataFrame:
    """runs: run, hits, misses, chars. run, hit_rate (1 without look-ups), tokens: a token for four characters begun."""
    n = F.col("hits") + F.col("misses")
    return runs.select("run", F.when(n > 0, F.col("hits") / n).otherwise(1.0).alias("hit_rate"), F.ceil(F.col("chars") / 4).alias("tokens"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two extractions of the same columns: rows that one has more often, with side (left, right)."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def minimised(items: list, fails: Callable[[list], bool]) -> list:
    """A smallest part of the items that still fails: no single one can go. Parts are halved first, as long as that helps.

    A loop on the driver over a list of inputs; what `fails` does with them may be a distributed query.
    """
    size = max(1, len(items) // 2)
    while items:
        at, smaller = 0, False
        while at < len(items):
            rest = items[:at] + items[at + size :]
            if rest and fails(rest):
                items, smaller = rest, True
            else:
                at += size
        if size == 1 and not smaller:
            break
        size = size if smaller and size == 1 else max(1, size // 2)
    return items
