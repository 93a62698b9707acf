"""A small MATCH language, compiled to joins.

MATCH (a:Label)-[:Kind]->(b:Label) WHERE a.name CONTAINS "x" RETURN a, b - one pattern of one or more steps, conditions joined
by AND on name or path with = (as written) or CONTAINS (any case), and the aliases to return.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph

_TOKEN = re.compile(r'\s*(?:(?P<string>"[^"]*")|(?P<word>\w+)|(?P<sign>-\[|\]->|<-\[|\]-|[():,.=]))')
PROPERTIES = ("name", "path")


class QueryError(ValueError):
    """A query that can't be read or that uses an unknown alias or word."""


@dataclass(frozen=True)
class Condition:
    alias: str
    name: str
    operator: str
    value: str


@dataclass(frozen=True)
class Query:
    aliases: tuple[tuple[str, str | None], ...]
    kinds: tuple[tuple[str | None, bool], ...]  # (kind, forward)
    conditions: tuple[Condition, ...]
    returned: tuple[str, ...]


def _tokens(text: str) -> list[str]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read the query from: {text[at:at + 20]!r}")
        out.append(m[m.lastgroup])
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self, *wanted: str) -> str:
        token = self.peek()
        if wanted and token.upper() not in wanted or not token:
            raise QueryError(f"expected {' or '.join(wanted) or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def name(self) -> str:
        token = self.next()
        if not re.fullmatch(r"\w+", token):
            raise QueryError(f"expected a name, found {token}")
        return token


def parse(text: str) -> Query:
    r = _Reader(text)
    r.next("MATCH")

    def node() -> tuple[str, str | None]:
        r.next("(")
        alias, label = r.name(), None
        if r.peek() == ":":
            r.next()
            label = r.name()
        r.next(")")
        return alias, label

    aliases, kinds = [node()], []
    while r.peek() in ("-[", "<-["):
        forward = r.next() == "-["
        kind = None
        if r.peek() == ":":
            r.next()
            kind = r.name()
        r.next("]->" if forward else "]-")
        kinds.append((kind, forward))
        aliases.append(node())
    known = [a for a, _ in aliases]
    if len(set(known)) < len(known):
        raise QueryError("an alias stands for one node of the pattern")
    conditions = []
    if r.peek().upper() == "WHERE":
        r.next()
        while True:
            alias = r.name()
            r.next(".")
            name = r.name()
            operator = r.next("=", "CONTAINS").upper()
            value = r.next()
            if value[0] != '"':
                raise QueryError(f"a value stands in double quotes: {value}")
            conditions.append(Condition(alias, name, operator, value[1:-1]))
            if r.peek().upper() != "AND":
                break
            r.next()
    r.next("RETURN")
    returned = [r.name()]
    while r.peek() == ",":
        r.next()
        returned.append(r.name())
    if r.peek():
        raise QueryError(f"unexpected {r.peek()} after the query")
    for alias in [*returned, *(c.alias for c in conditions)]:
        if alias not in known:
            raise QueryError(f"unknown alias {alias}; the pattern has {', '.join(known)}")
    return Query(tuple(aliases), tuple(kinds), tuple(conditions), tuple(returned))


def plan(graph: PropertyGraph, query: Query) -> DataFrame:
    """Distinct rows: for each returned alias its id, and its name as alias_name. Conditions stand before the joins."""
    sides = []
    for alias, label in query.aliases:
        rows = graph.nodes.where(F.col("label") == label) if label else graph.nodes
        for c in query.conditions:
            if c.alias == alias:
                if c.name not in PROPERTIES:
                    rows = rows.where(F.lit(False))
                elif c.operator == "=":
                    rows = rows.where(F.col(c.name) == c.value)
                else:
                    rows = rows.where(F.lower(c.name).contains(c.value.lower()))
        sides.append(rows.select(F.col("id").alias(alias), F.col("name").alias(f"{alias}_name")))
    out = sides[0]
    for k, (kind, forward) in enumerate(query.kinds):
        a, b = query.aliases[k][0], query.aliases[k + 1][0]
        edges = graph.edges.where(F.col("kind") == kind) if kind else graph.edges
        ends = edges.select(F.col("source" if forward else "target").alias(a), F.col("target" if forward else "source").alias(b)).distinct()
        out = out.join(ends, a).join(sides[k + 1], b)
    return out.select(*[x for a in query.returned for x in (a, f"{a}_name")]).distinct()


def run(graph: PropertyGraph, text: str) -> DataFrame:
    return plan(graph, parse(text))
