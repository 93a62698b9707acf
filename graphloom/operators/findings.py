"""Findings over graphs, tags and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.classify import let
from graphloom.operators import extract

# Limits of the health rules, and the tension each rule stands for.
GOD, BRIDGE, LOW_COHESION, SHOTGUN = 12, 8, 0.25, 5
LAYER_ORDER = ("Ui", "Api", "Domain", "Data")
TENSIONS = {"HiddenCoupling": "Coupling", "LayerViolation": "LayerViolation", "ShotgunSurgery": "Coupling", "Orphan": "DeadWeight", "GodClass": "Complexity", "Bridge": "Coupling", "Cycle": "Cyclicity", "LowCohesion": "Fragmentation"}
# Comment prefixes and what they mean; words of plans; words of opinion; keys whose values are secret.
RATIONALE = {
    "RATIONALE": "Why", "IMPORTANT": "Important", "SAFETY": "Safety", "FIXME": "Fixme", "NOTE": "Note", "HACK": "Hack", "TODO": "Todo", "WHY": "Why",
    "BUG": "Fixme", "XXX": "Hack",
}
INTENT = ("todo", "fixme", "not yet implemented", "not implemented", "coming soon", "planned", "will support", "should support")
FUTURE = ("todo", "planned", "not yet", "will eventually", "roadmap")
SUBJECTIVE = (" should ", "best ", "prefer ", "recommended", "easy ", "simple ")
SECRET_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "credential")
REDACTED = "[REDACTED]"
#: Names that are broadcast to the lines they are looked for in.
MOST_NAMES = 100_000


def health(degree: DataFrame, edges: DataFrame, cohesion: DataFrame | None = None, god: int = GOD, bridge: int = BRIDGE, layers: DataFrame | None = None, shotgun: int = SHOTGUN) -> DataFrame:
    """degree: id, degree. Findings rule, id: Orphan, GodClass, Bridge, Cycle (two nodes that point at each other), LowCohesion.

    Edges with a kind give more: HiddenCoupling for each FileChangesWith edge without another one between its ends,
    ShotgunSurgery for nodes with `shotgun` or more of them; layers (id, layer) give LayerViolation for edges that go up.
    """
    rules = F.array(
        F.when(F.col("degree") == 0, "Orphan"), F.when(F.col("degree") >= god, "GodClass"), F.when(F.col("degree") >= bridge, "Bridge")
    )
    out = degree.select(F.explode(F.array_compact(rules)).alias("rule"), "id")
    steps = edges.where("source <> target").select("source", "target").distinct()
    back = steps.select(F.col("source").alias("target"), F.col("target").alias("source"))
    cycles = steps.join(back, ["source", "target"]).where("source < target")
    out = out.unionByName(cycles.select(F.lit("Cycle").alias("rule"), F.concat_ws("|", "source", "target").alias("id")))
    if cohesion is not None:
        low = cohesion.where(F.col("cohesion") <= LOW_COHESION)
        out = out.unionByName(low.select(F.lit("LowCohesion").alias("rule"), F.col("community").cast("string").alias("id")))
    if "kind" in edges.columns:
        ends = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "kind")
        together = ends.where("kind = 'FileChangesWith'").select("a", "b").distinct()
        hidden = together.join(ends.where("kind <> 'FileChangesWith'"), ["a", "b"], "left_anti")
        out = out.unionByName(hidden.select(F.lit("HiddenCoupling").alias("rule"), F.concat_ws("|", "a", "b").alias("id")))
        spread = together.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().where(F.col("count") >= shotgun)
        out = out.unionByName(spread.select(F.lit("ShotgunSurgery").alias("rule"), "id"))
    if layers is not None:
        place = F.array_position(F.array(*map(F.lit, LAYER_ORDER)), F.col("layer"))
        known = layers.select("id", place.alias("place")).where("place > 0")
        up = edges.join(known.select(F.col("id").alias("source"), F.col("place").alias("x")), "source").join(known.select(F.col("id").alias("target"), F.col("place").alias("y")), "target")
        out = out.unionByName(up.where("x > y").select(F.lit("LayerViolation").alias("rule"), F.concat_ws("|", "source", "target").alias("id")))
    return out.distinct()


def tensions(findings: DataFrame) -> DataFrame:
    """category, id; a Bridge is BlastRadius too."""
    pairs = F.create_map(*[F.lit(x) for k, v in TENSIONS.items() for x in (k, v)])
    both = F.array_compact(F.array(pairs[F.col("rule")], F.when(F.col("rule") == "Bridge", "BlastRadius")))
    return findings.select(F.explode(both).alias("category"), "id")


def tag_facets(tags: DataFrame) -> DataFrame:
    """tags: entity_id, namespace, value. tag, n."""
    return tags.groupBy(F.concat_ws(":", "namespace", "value").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def parse_tag_expression(expression: str) -> list[tuple[list[str], list[str]]]:
    """Branches (";") of terms (","), each (wanted, refused "!"). A term without ":" or a branch without a wanted term is an error."""
    out = []
    for branch in expression.split(";"):
        terms = [t.strip() for t in branch.split(",") if t.strip()]
        wanted, refused = [t for t in terms if t[0] != "!"], [t[1:].strip() for t in terms if t[0] == "!"]
        for t in wanted + refused:
            if ":" not in t:
                raise ValueError(f"a term is namespace:value, not {t!r}")
        if not wanted:
            raise ValueError(f"a branch needs a term to include: {branch!r}")
        out.append((wanted, refused))
    return out


def resolve_tags(tags: DataFrame, expression: str) -> DataFrame:
    """Entities whose tags satisfy one branch at least: entity_id."""
    branches = parse_tag_expression(expression)
    named = sorted({t for b in branches for terms in b for t in terms})
    tag = F.concat_ws(":", "namespace", "value")
    have = tags.where(tag.isin(*named)).groupBy("entity_id").agg(F.collect_set(tag).alias("have"))
    ok = F.lit(False)
    for wanted, refused in branches:
        one = F.lit(True)
        for t in wanted:
            one &= F.array_contains("have", t)
        for t in refused:
            one &= ~F.array_contains("have", t)
        ok |= one
    return have.where(ok).select("entity_id")


def rationale(lines: DataFrame) -> DataFrame:
    """Comment lines PREFIX: or PREFIX(owner): in doc_id, line, kind, owner, note."""
    pattern = r"^\s*(?:#|//|/\*|\*|--)?\s*(" + "|".join(RATIONALE) + r")(?:\(([^)]*)\))?:\s*(.*?)\s*$"
    kinds = F.create_map(*[F.lit(x) for k, v in RATIONALE.items() for x in (k, v)])
    found = lines.where(F.col("text").rlike(pattern))
    part = lambda i: F.regexp_extract("text", pattern, i)
    return found.select("doc_id", "line", kinds[part(1)].alias("kind"), part(2).alias("owner"), part(3).alias("note"))


def intent_lines(lines: DataFrame, excerpt: int = 160) -> DataFrame:
    """Lines that speak of work to be done: doc_id, line, keyword (the first of the list), excerpt."""
    low = F.lower("text")
    keyword = F.coalesce(*[F.when(low.contains(k), F.lit(k)) for k in INTENT])
    return lines.select("doc_id", "line", keyword.alias("keyword"), F.substring(F.trim("text"), 1, excerpt).alias("excerpt")).where("keyword IS NOT NULL")


def claims(lines: DataFrame) -> DataFrame:
    """What a line claims: doc_id, line, claim. A first rule that fits decides: blank, in a code fence, future, subjective, Route, Path, EnvVar, Statement."""
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.trim("text").startswith("```")
    low = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    has = lambda words: low.rlike("|".join(words))
    claim = (
        F.when(F.trim("text") == "", "Blank")
        .when(fence | (F.pmod(F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)), F.lit(2)) == 1), "Fenced")
        .when(has(FUTURE), "Future")
        .when(has(SUBJECTIVE), "Subjective")
        .when(F.col("text").rlike(r"\b(GET|POST|PUT|DELETE|PATCH) /"), "Route")
        .when(F.col("text").rlike(r"[A-Za-z0-9_]+/[A-Za-z0-9_/]+\.[a-z]+"), "Path")
        .when(F.col("text").rlike(r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b"), "EnvVar")
        .otherwise("Statement")
    )
    return lines.select("doc_id", "line", claim.alias("claim"))


def redact(text: Column) -> Column:
    """Values after a secret-bearing key become ***."""
    return F.regexp_replace(text, r"(?i)(" + "|".join(SECRET_KEYS) + r")(\s*[:=]\s*[\"']?)[^\s\"']+", "$1$2***")


def redact_text(text: Column) -> Column:
    """A file's text line by line: values of secret keys, up to the end of the line, and all lines within private-key blocks are masked."""
    keys = "|".join(SECRET_KEYS)
    values = F.regexp_replace(text, rf"(?im)^([^=:\n]*(?:{keys})[^=:\n]*)([=:]).*$", rf"$1$2 {REDACTED.replace('[', chr(92) + '[')}")
    blocks = F.split(values, r"(?<=PRIVATE KEY-----)(?=\n)")
    begins = lambda x: x.rlike(r"-----BEGIN [^\n]*PRIVATE KEY-----$")
    masked = F.transform(blocks, lambda x, i: F.when((i > 0) & begins(F.get(blocks, i - 1)), F.concat(F.regexp_replace(F.regexp_extract(x, r"(?s)^(.*?)(\n[^\n]*-----END [^\n]*)?$", 1), r"(?m)(?<=\n)[^\n]+", F.lit(REDACTED)), F.regexp_extract(x, r"(?s)^(.*?)(\n[^\n]*-----END [^\n]*)?$", 2))).otherwise(x))
    return F.array_join(masked, "")


def _grams(letters: Column) -> Column:
    """The distinct runs of one to three letters."""
    at = lambda i, n: F.concat(*[F.get(letters, i + k) for k in range(n)])
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(letters) - 1, F.lit(0))), lambda i: F.array(at(i, 1), at(i, 2), at(i, 3)))
    return F.array_distinct(F.filter(F.flatten(runs), lambda x: x.isNotNull()))


def unmentioned(names: DataFrame, name: str, lines: DataFrame) -> DataFrame:
    """names that no line has in it, in any case. lines: text.

    Lines are joined on the names' first runs of letters and digits, so it is an equi-join; what contains the name is confirmed.
    Few names go to the lines; many are joined by a shuffle. Lines laid out in words are never sent to all.
    """
    few = names.count() <= MOST_NAMES
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    low = F.lower(name)
    # the longest word of a name stands whole in a line that contains it, unless it is cut at the name's ends
    inner = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    keyed = names.select(name, low.alias("_low"), F.size(inner).alias("_n"), inner.alias("_words"))
    safe = F.slice("_words", 2, F.greatest(F.col("_n") - 2, F.lit(0)))
    closed = keyed.withColumn("_key", F.when((F.col("_n") > 2), F.element_at(F.array_sort(safe, lambda a, b: F.length(b) - F.length(a)), 1)))
    by_word = closed.where("_key IS NOT NULL")
    spread = lines.select("text", F.explode(words(F.col("text"))).alias("_key"))
    met = lambda laid, own, on: laid.join(F.broadcast(own), on) if few else laid.hint("merge").join(own, on)
    hit = met(spread, by_word, "_key").where(F.lower("text").contains(F.col("_low"))).select(name)
    # short names have no word inside: they are looked up by their first letters among the runs of one to three letters of lines
    rest = closed.where("_key IS NULL").select(name, "_low", F.substring("_low", 1, 3).alias("_gram"))
    grams = lines.select("text", F.explode(let(F.split(F.lower("text"), ""), _grams)).alias("_gram"))
    found = met(grams, rest.where("_low <> ''"), "_gram").where(F.lower("text").contains(F.col("_low"))).select(name)
    found = found.unionByName(rest.where("_low = ''").crossJoin(lines.select(F.lit(1)).limit(1)).select(name))
    return names.join(hit.unionByName(found).distinct(), name, "left_anti")


def drift(documents: DataFrame, files: DataFrame) -> DataFrame:
    """documents, files: path, content. path, line, rule, subject: what documents say that the files do not bear out.

    BrokenLink and MissingPath name no file, StaleCommand a make target that no Makefile has, UnresolvedIntent work to be done.
    """
    have = files.select("path").distinct()
    missing = lambda df, column: df.join(have.withColumnRenamed("path", column), column, "left_anti")
    row = lambda df, rule, subject: df.select("path", "line", F.lit(rule).alias("rule"), subject.alias("subject"))
    broken = row(missing(extract.links(documents).where("resolved IS NOT NULL"), "resolved"), "BrokenLink", F.col("target"))
    paths = row(missing(extract.path_references(documents), "reference"), "MissingPath", F.col("reference"))
    asked = extract.commands(documents).withColumn("goal", F.regexp_extract("command", r"^make\s+(\S+)", 1)).where("goal <> ''")
    made = extract.lines_of(files.where(F.element_at(F.split("path", "/"), -1) == "Makefile"))
    goals = made.select(F.regexp_extract("text", r"^([A-Za-z0-9_.\-]+)\s*:(?!=)", 1).alias("goal")).where("goal <> ''").distinct()
    stale = row(asked.join(goals, "goal", "left_anti"), "StaleCommand", F.col("command"))
    open_lines = extract.fenced(extract.lines_of(documents)).where("NOT fence AND NOT inside").withColumnRenamed("path", "doc_id")
    intent = row(intent_lines(open_lines).withColumnRenamed("doc_id", "path"), "UnresolvedIntent", F.col("excerpt"))
    return broken.unionByName(paths).unionByName(stale).unionByName(intent)


def checked_references(references: DataFrame, files: DataFrame) -> DataFrame:
    """references: ref (path#Lx or path#Lx-Ly). files: path, n_lines. ref, state: valid, malformed, unknown_path or bad_lines."""
    pattern = r"^(.+)#L(\d+)(?:-L(\d+))?$"
    part = lambda k: F.regexp_extract("ref", pattern, k)
    rows = references.select("ref", part(1).alias("path"), part(2).try_cast("long").alias("a"), F.coalesce(F.nullif(part(3), F.lit("")), part(2)).try_cast("long").alias("b"))
    joined = rows.join(files.select("path", "n_lines"), "path", "left")
    state = (
        F.when(F.col("path") == "", "malformed").when(F.col("n_lines").isNull(), "unknown_path")
        .when((F.col("a") < 1) | (F.col("b") < F.col("a")) | (F.col("b") > F.col("n_lines")), "bad_lines").otherwise("valid")
    )
    return joined.select("ref", state.alias("state"))
