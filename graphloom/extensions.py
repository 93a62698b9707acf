"""What may be plugged in: embeddings, resolvers, agents over tables, analyzers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import extract, relational, search


class Embedder(Protocol):
    """Rows of id, text to rows of id, bucket, value; purpose says whether texts are documents or a question."""

    name: str

    def embed(self, texts: DataFrame, purpose: str = "document") -> DataFrame: ...


@dataclass(frozen=True)
class HashedEmbedder:
    """Feature hashing; a prompt may stand before documents or questions."""

    dimensions: int = search.DIMENSIONS
    document_prompt: str = ""
    query_prompt: str = ""
    name: str = "hashed"

    def embed(self, texts: DataFrame, purpose: str = "document") -> DataFrame:
        if purpose not in ("document", "query"):
            raise ValueError(f"purpose is document or query, not {purpose}")
        prompt = self.document_prompt if purpose == "document" else self.query_prompt
        rows = texts.select("id", F.concat(F.lit(prompt + " "), "text").alias("text")) if prompt else texts.select("id", "text")
        return search.hashed_embedding(rows, self.dimensions)


class Resolver(Protocol):
    """A strategy: references (key and what it needs) to found rows (key, target)."""

    name: str

    def resolve(self, references: DataFrame) -> DataFrame: ...


def resolve_with(references: DataFrame, resolvers: list[Resolver], accepted: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """references: key, kind. key, target, strategy: the first resolver in order that finds an accepted target.

    accepted: kind, label (which labels a kind may point to); labels: target, label. Kinds that accepted does not list may
    point anywhere.
    """
    found = []
    for r in resolvers:
        hits = r.resolve(references).select("key", "target")
        if accepted is not None and labels is not None:
            kinds = references.select("key", "kind")
            allowed = accepted.select("kind", "label", F.lit(True).alias("ok"))
            listed = accepted.select("kind").distinct().withColumn("listed", F.lit(True))
            checked = hits.join(kinds, "key").join(labels, "target", "left").join(listed, "kind", "left").join(allowed, ["kind", "label"], "left")
            hits = checked.where("listed IS NULL OR ok").select("key", "target")
        found.append((r.name, hits.groupBy("key").agg(F.min("target").alias("target"))))
    return relational.first_resolved(references.select("key"), "key", found, "target")


class Agent(Protocol):
    """A computation over named tables."""

    inputs: tuple[str, ...]

    def compute(self, tables: dict[str, DataFrame]) -> DataFrame: ...

    def validate(self, result: DataFrame) -> DataFrame: ...


def run_agent(agent: Agent, tables: dict[str, DataFrame]) -> DataFrame:
    """The result, if all inputs are there and its validate() finds no row to complain about; an error otherwise."""
    missing = [x for x in agent.inputs if x not in tables]
    if missing:
        raise ValueError(f"inputs are missing: {', '.join(missing)}")
    result = agent.compute({x: tables[x] for x in agent.inputs})
    wrong = agent.validate(result).limit(3).collect()
    if wrong:
        raise ValueError(f"the result is not valid: {wrong}")
    return result


#: Which extractor gives which facts; each takes files (path, content) and returns rows with a path.
ANALYZERS: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {
    "Markdown": {"headings": extract.headings, "links": extract.links, "commands": extract.commands, "paths": extract.path_references},
    "Dockerfile": {"steps": extract.container_steps},
    "Environment": {"assignments": extract.assignments},
    "Protocol": {"calls": extract.protocol_calls},
    "Requirements": {"packages": extract.requirements},
    "Structured": {"values": extract.structured},
    "GenericText": {"facts": extract.generic_facts},
}


def analyzed(files: DataFrame, analyzer: str) -> dict[str, DataFrame]:
    """files: path, content, kind (the analyzer of each). The facts of the files of one analyzer, by name."""
    mine = files.where(F.col("kind") == analyzer)
    return {name: make(mine) for name, make in ANALYZERS[analyzer].items()}


def fact_edges(facts: DataFrame, kind: str, target: str) -> DataFrame:
    """facts: path and a target column. Edges id, source, target, kind from the file's node to what it names; each once."""
    source, to = F.concat(F.lit("artifact:"), "path"), F.col(target)
    return facts.where(to.isNotNull()).select(F.concat_ws("|", F.lit(kind), source, to).alias("id"), source.alias("source"), to.alias("target"), F.lit(kind).alias("kind")).distinct()
