"""Quality rules as a short-circuit cascade; DataFrame operations only.

Each rule's cost and selectivity are estimated on a random sample of whole texts. Rules are ordered by rejection per cost, and
a chain of CASE branches stops at the first that rejects: the features of later rules are not computed. A text is split into
words once for all rules. The order changes the cost only, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE_CLASS, text_of, written

#: Texts of the sample, about, and how often each rule is timed on it; the least time counts, so that compiling does not.
SAMPLE_TEXTS, TIMES = 1000, 3
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """rejects: a condition over the features it names as its parameters."""

    name: str
    rejects: Callable[..., Column]

    @property
    def needs(self) -> tuple[str, ...]:
        return self.rejects.__code__.co_varnames[: self.rejects.__code__.co_argcount]


#: Production rules. The first two are the base rules.
RULES = (
    Rule("too_few_words", lambda n_words: n_words < 50),
    Rule("repeated_words", lambda n_words, n_repeat_words: 100 * n_repeat_words > 50 * n_words),
    Rule("symbols", lambda n_symbols, word_chars: 5 * n_symbols > word_chars),
    Rule("repeated_lines", lambda n_dup_lines, n_lines: 2 * n_dup_lines > n_lines),
    Rule("word_length", lambda n_words, word_chars: (word_chars < 2 * n_words) | (word_chars > 20 * n_words)),
)
BASE = ("too_few_words", "repeated_words")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda's variable can't be replaced by what it stands for."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words in windows of three words that occur twice or more. w: a variable, for it is used in lambdas.

    Windows are sorted by a hash, and neighbours of one hash are compared word by word. Where two that differ have one hash,
    which almost never is, windows are sorted as strings.
    """
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    zero = F.array().cast("array<int>")

    def counted(windows: Column, equal: Callable[[Column, Column], Column]) -> Column:
        pairs = F.arrays_zip(F.slice(windows, 1, F.size(windows) - 1).alias("a"), F.slice(windows, 2, F.size(windows) - 1).alias("b"))
        twice = F.flatten(F.transform(pairs, lambda x: F.when(equal(x["a"], x["b"]), F.array(x["a"]["i"], x["b"]["i"])).otherwise(zero)))
        # a window adds the words up to the next such window's start, three at most; the last adds three
        return F.aggregate(
            F.sort_array(F.array_distinct(twice)),
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def by_hash(h: Column) -> Column:
        windows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same_words = lambda a, b: (F.get(w, a["i"]) == F.get(w, b["i"])) & (F.get(w, a["i"] + 1) == F.get(w, b["i"] + 1)) & (F.get(w, a["i"] + 2) == F.get(w, b["i"] + 2))

        def of(x: Column) -> Column:
            pairs = F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x) - 1).alias("b"))
            clash = F.exists(pairs, lambda y: (y["a"]["h"] == y["b"]["h"]) & ~same_words(y["a"], y["b"]))
            return F.when(~clash, counted(x, lambda a, b: a["h"] == b["h"])).otherwise(by_string())

        return _let(windows, of)

    def by_string() -> Column:
        window = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i"))
        return _let(F.sort_array(F.transform(starts, window)), lambda x: counted(x, lambda a, b: a["s"] == b["s"]))

    suspect = lambda h: F.when(F.size(F.array_distinct(h)) < n - 2, by_hash(h)).otherwise(0)
    return F.when(n > 3, _let(hashes, suspect)).otherwise(0).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


#: Each feature from the text and its words.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, w: F.size(w).cast("long"),
    "word_chars": lambda text, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda text, w: (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long"),
    "n_lines": lambda text, w: F.size(_lines(text)).cast("long"),
    "n_dup_lines": lambda text, w: _let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    "n_repeat_words": lambda text, w: _repeat_words(w),
}


def verdict(text: Column, rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The name of the first rule that rejects, or null. Later rules' features are not computed."""

    def chain(w: Column) -> Column:
        out = F.lit(None).cast("string")
        for rule in reversed(rules):
            out = F.when(rule.rejects(*(FEATURES[k](text, w) for k in rule.needs)), F.lit(rule.name)).otherwise(out)
        return out

    return _let(words(text), chain)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) of each rule over a sample, ordered by rejection per second, then by name.

    The sample is random and of whole texts, of any length; it is written as a table and does not reach the driver.
    """
    share = min(1.0, SAMPLE_TEXTS / max(1, docs.count()))
    sample = written(docs.select(text_of(text_col).alias("text")).sample(share, 1).coalesce(1), "quality-sample")

    def measured(condition: Column) -> tuple[float, float]:
        took = []
        for _ in range(TIMES):
            began = time.perf_counter()
            hit = sample.agg(F.coalesce(F.avg(condition.cast("int")), F.lit(0.0))).collect()[0][0]
            took.append(time.perf_counter() - began)
        return min(took), hit

    idle, _ = measured(F.size(words(F.col("text"))) < 0)
    found = [(r, *measured(verdict(F.col("text"), [r]).isNotNull())) for r in rules]
    found = [(r, max(1e-4, s - idle), share) for r, s, share in found]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, the base features, base_failed, kept, and rejected_by (the first rule, or null).

    All base features are returned, so all are computed here, once each; the cascade runs over them. drop_rejected() skips the
    features of rules that are not reached. A null or empty text has no words and fails too_few_words. Repeated rows are
    judged each; a null id stays null; an empty table gives an empty result; other columns are not read. A very long text is
    judged whole; its memory is some 50 bytes for each word.
    """
    order = [r for r, _, _ in estimate(docs, rules, text_col)]
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    made = base.select("doc_id", _let(words(F.col("text")), lambda w: F.struct(*[f(F.col("text"), w).alias(k) for k, f in FEATURES.items()])).alias("f"))
    made = made.select("doc_id", "f.*")
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(rule.rejects(*map(F.col, rule.needs)), F.lit(rule.name)).otherwise(out)
    failed = F.lit(False)
    for rule in RULES:
        if rule.name in BASE:
            failed = failed | rule.rejects(*map(F.col, rule.needs))
    return made.withColumn("rejected_by", out).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"), "n_lines", "rejected_by",
    )


def drop_rejected(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs without the rows that a rule rejects; all columns stay, and a rule's features are computed only if it is reached.

    A null or empty text has no words and is rejected; repeated rows are judged each, null ids too; an empty table stays empty;
    a very long text is judged whole.
    """
    order = [r for r, _, _ in estimate(docs, rules, text_col)]
    return docs.where(verdict(text_of(f"`{text_col}`"), order).isNull())
