"""Results of operators kept by what they were made from: the inputs' digests, the operator's version and its parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import _located
from graphloom.store import cached

RESULTS, DIGESTS = "results", "digests"


def table_digest(table: DataFrame) -> str:
    """A digest of a table's columns and rows that does not depend on their order or partitions; repeated rows count.

    Sums of two 64-bit hashes of each row, in whole numbers of 38 digits: two tables of the same digest that differ have to agree
    in 128 bits.
    """
    columns = sorted(table.columns)
    cells = [F.col(f"`{c}`") for c in columns]
    # a null is no value of any kind: its place is hashed with it
    known = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cells]) if cells else F.lit("")
    kinds = dict(table.dtypes)
    cells = [F.to_json(c) if "map<" in kinds[n] else c for n, c in zip(columns, cells)]
    sums = [F.sum(F.xxhash64(F.lit(k), known, *cells).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    row = table.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    text = json.dumps([[c, kinds[c]] for c in columns] + [row["n"], str(row["s0"]), str(row["s1"])])
    return hashlib.sha256(text.encode()).hexdigest()


class Kept:
    """A folder of results. hits and misses count what was asked for; orphans are results that were not."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hits = self.misses = 0
        self.asked: set[str] = set()

    def _state(self, table: DataFrame) -> str | None:
        """What a table over files is by its plan and its files' names, sizes and times, which are found without reading it."""
        files = sorted(table.inputFiles())
        if not files:
            return None
        listed = []
        for name in files:
            file_system, at = _located(self.spark, name)
            status = file_system.getFileStatus(at)
            listed.append([name, status.getLen(), status.getModificationTime()])
        return hashlib.sha256(json.dumps([listed, table.semanticHash(), table.schema.json()]).encode()).hexdigest()

    def digest(self, table: DataFrame) -> str:
        """table_digest(), remembered for tables over files as long as the files are the same."""
        state = self._state(table)
        if state is None:
            return table_digest(table)
        made = lambda: self.spark.createDataFrame([(table_digest(table),)], "digest string")
        return cached(self.spark, f"{self.folder}/{DIGESTS}", state, made)[0].first().digest

    def result(self, operator: str, version: int, parameters: dict, inputs: dict[str, DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
        """The operator's result for these inputs; make() is called if it is not there, or can't be read."""
        text = json.dumps([operator, version, parameters, {k: self.digest(t) for k, t in sorted(inputs.items())}], sort_keys=True)
        key = hashlib.sha256(text.encode()).hexdigest()
        self.asked.add(key)
        found, there = cached(self.spark, f"{self.folder}/{RESULTS}", key, make)
        self.hits, self.misses = self.hits + there, self.misses + (not there)
        return found

    def remove_orphans(self) -> int:
        """Delete the results that were not asked for since this was made; how many."""
        file_system, at = _located(self.spark, f"{self.folder}/{RESULTS}")
        if not file_system.exists(at):
            return 0
        gone = [s.getPath() for s in file_system.listStatus(at) if s.getPath().getName() not in self.asked]
        for path in gone:
            file_system.delete(path, True)
        return len(gone)


def near_lines(kept: Kept, sets: DataFrame, least: float = 0.6) -> DataFrame:
    from graphloom.operators.similarity import near_pairs

    return kept.result("near_lines", 1, {"least": least}, {"sets": sets}, lambda: near_pairs(sets, least))


def components(kept: Kept, links: DataFrame) -> DataFrame:
    from graphloom.operators.components import components as made

    return kept.result("components", 1, {}, {"links": links}, lambda: made(links))


def labelled(kept: Kept, nodes: DataFrame, distance: float, limit: int | None = None) -> DataFrame:
    from graphloom.operators.labels import labelled as made

    return kept.result("labels", 1, {"distance": distance, "limit": limit}, {"nodes": nodes}, lambda: made(nodes, distance, limit))
