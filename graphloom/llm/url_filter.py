"""URL filters on a sorted digest array.

The rules are kept as sorted 64-bit xxhash keys with the full strings beside them, in parts of the digest range that Spark
sorts and tasks write to the shared folder, so the list may be a table of any size. Workers memory-map the parts, probe them by
vectorised binary search, and compare the stored string, so that no collision gives a verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh_path, prepare, shared_map, shared_save

BLOCK, ALLOW = 0, 1
#: The rules of the query: host and path together, with the verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Hosts (with their subdomains) that the method blocks where no rule fits, beside those that junk_hosts() finds.
BLOCKED_HOSTS = tuple(f"{n}.example.{t}" for n in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for t in ("com", "net", "org"))
#: Runs of symbols that make a page junk, and the share of junk pages from which a host is blocked.
JUNK, JUNK_SHARE = r"%%%|###|\*\*\*|\$\$\$", 0.5
#: Entries of a part of the digest array, about.
PART_ENTRIES = 2_000_000
SEED = 42  # that of Spark's xxhash64
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Index:
    """Where the parts are, which there are, and the lengths of the rules' paths, longest first."""

    path: str
    parts: int
    there: frozenset[int]
    paths: tuple[int, ...]


def digest_array(entries: list[tuple[bytes, int]]) -> dict[str, np.ndarray]:
    """Sorted keys of (string, verdict) entries, their verdicts and strings. Entries with one key stand side by side, so a probe walks over them."""
    rows = sorted((xxhash.xxh64_intdigest(e, SEED), e, v) for e, v in entries)
    texts = [e for _, e, _ in rows]
    return {
        "keys": np.array([k for k, _, _ in rows], np.uint64),
        "verdicts": np.array([v for _, _, v in rows], np.uint8),
        "starts": np.concatenate(([0], np.cumsum([len(e) for e in texts]))).astype(np.int64),
        "strings": np.frombuffer(b"".join(texts), np.uint8),
    }


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _entries(spark: SparkSession, rules: dict[str, str] | DataFrame, blocked: tuple[str, ...] | DataFrame) -> DataFrame:
    """entry, verdict, path (its length; null for a blocked host); of an entry that is there twice, a block counts."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(h,) for h in blocked], "host string")
    needs = F.when(F.instr("rule", "/") > 0, F.col("rule")).otherwise(F.raise_error(F.concat(F.lit("a rule needs a path, if only /: "), F.col("rule"))))
    verdict = F.when(F.lower("verdict") == "block", BLOCK).otherwise(ALLOW)
    own = rules.where("rule IS NOT NULL").select(needs.alias("entry"), verdict.alias("verdict"))
    own = own.withColumn("path", F.octet_length("entry") - F.octet_length(F.substring_index("entry", "/", 1)))
    hosts = blocked.where("host IS NOT NULL AND host <> ''").select(F.col("host").alias("entry"), F.lit(BLOCK).alias("verdict"), F.lit(None).cast("int").alias("path"))
    return own.unionByName(hosts).groupBy("entry").agg(F.min("verdict").alias("verdict"), F.min("path").alias("path"))


def build_index(spark: SparkSession, rules: dict[str, str] | DataFrame = RULES, blocked: tuple[str, ...] | DataFrame = BLOCKED_HOSTS, part_entries: int = PART_ENTRIES) -> Index:
    """The digest array of rules (a table: rule, verdict) and blocked hosts (a table: host), both in lower case.

    A rule is host + path, its path from the first "/" on; a blocked host is kept without a path. To the driver go the numbers
    of the parts and the distinct lengths of paths.
    """
    prepare(spark)
    entries = _entries(spark, rules, blocked)
    parts = max(1, -(-entries.count() // part_entries))
    folder = fresh_path(spark, "url-index")
    key = F.xxhash64("entry")
    part = F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * F.lit(parts).cast("long"), 32).cast("int")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, int]]] = {}

        def save() -> pa.RecordBatch:
            (part, rows), = held.items()
            shared_save(f"{folder}/part-{part:06d}.bin", **digest_array(rows))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

        for batch in batches:
            for p, e, v in zip(*(c.to_pylist() for c in batch.columns)):
                if held and p not in held:
                    yield save()
                held.setdefault(p, []).append((e.encode(), v))
        if held:
            yield save()

    sorted_entries = entries.select(part.alias("part"), "entry", "verdict").repartition("part").sortWithinPartitions("part")
    there = frozenset(r.part for r in sorted_entries.mapInArrow(write, "part int").collect())
    lengths = [r.path for r in entries.where("path IS NOT NULL").select("path").distinct().collect()]
    return Index(folder, parts, there, tuple(sorted(lengths, reverse=True)))


_PARTS: dict[tuple[str, int], dict[str, np.ndarray]] = {}


def look_up(index: Index, strings: list[bytes]) -> np.ndarray:
    """In a worker: the verdict of the entry that equals each string, or -1."""
    out = np.full(len(strings), -1, np.int64)
    part = _part_of(np.array([xxhash.xxh64_intdigest(s, SEED) for s in strings], np.uint64), index.parts)
    for p in np.unique(part).tolist():
        if p not in index.there:
            continue
        if (index.path, p) not in _PARTS:
            _PARTS[index.path, p] = shared_map(f"{index.path}/part-{p:06d}.bin")
        mine = np.flatnonzero(part == p)
        found = probe(_PARTS[index.path, p], [strings[i] for i in mine.tolist()])
        hit = found >= 0
        out[mine[hit]] = _PARTS[index.path, p]["verdicts"][found[hit]]
    return out


def probe(index: dict[str, np.ndarray], strings: list[bytes]) -> np.ndarray:
    """The entry that equals each string, or -1."""
    keys, n = index["keys"], len(strings)
    found = np.full(n, -1, np.int64)
    if not n or not len(keys):
        return found
    want = np.array([xxhash.xxh64_intdigest(s, SEED) for s in strings], np.uint64)
    at = np.searchsorted(keys, want)
    hits = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == want)
    starts, stored = index["starts"], index["strings"]
    for i in hits.tolist():  # a hit is confirmed by its string
        k = int(at[i])
        while k < len(keys) and keys[k] == want[i]:
            if stored[starts[k] : starts[k + 1]].tobytes() == strings[i]:
                found[i] = k
                break
            k += 1
    return found


def judge(index: Index, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
    """The longest rule that fits each host and path, and the verdict. Ties can't be: two rules of one length that fit are equal or differ in host and path lengths, and then the longer host wins."""
    sizes = index.paths
    probes: dict[bytes, int] = {}
    wanted: list[list[tuple[int, int, int]]] = []
    for host, path in zip(hosts, paths):
        h, p = host.encode(), path.encode()
        tails = [h] if h else []
        at = h.find(b".")
        while at >= 0:
            tails.append(h[at + 1 :])
            at = h.find(b".", at + 1)
        mine = []
        for tail in tails:
            for size in sizes:
                if size <= len(p):
                    mine.append((len(tail) + size, len(tail), probes.setdefault(tail + p[:size], len(probes))))
            mine.append((-1, len(tail), probes.setdefault(tail, len(probes))))
        wanted.append(mine)
    strings = list(probes)
    found = look_up(index, strings).tolist()
    rules, out = [], []
    for mine in wanted:
        hit = max((x for x in mine if found[x[2]] >= 0), default=None)
        if hit is None:
            rules.append(None)
            out.append("allow")
        else:
            rules.append(strings[hit[2]].decode() if hit[0] >= 0 else None)
            out.append("block" if found[hit[2]] == BLOCK else "allow")
    return rules, out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a URL; both empty for null or without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def junk_hosts(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = JUNK_SHARE) -> DataFrame:
    """host: those of which at least the share of their pages is junk. A null page is none; an empty host is never listed."""
    host, _ = host_and_path(F.col(url_col).cast("string"))
    junk = F.coalesce(F.col(html_col).cast("string").rlike(JUNK), F.lit(False)).cast("int")
    return pages.select(host.alias("host"), junk.alias("junk")).where("host <> ''").groupBy("host").agg(F.avg("junk").alias("junk")).where(F.col("junk") >= share).select("host")


def filter_urls(pages: DataFrame, rules: dict[str, str] | DataFrame = RULES, blocked: tuple[str, ...] | DataFrame = BLOCKED_HOSTS, id_col: str = "page_id", url_col: str = "url", index: Index | None = None) -> DataFrame:
    """One row for each input row: page_id, host, path, rule, verdict.

    The longest rule that fits decides (rule: its host + path); without one, "block" if the host or a parent of it is in
    `blocked`, else "allow". rules and blocked may be tables; an index that is built already may be given. A null URL or one
    without "://" has an empty host and path and no rule, and is allowed. Repeated rows are judged each; a null id stays null,
    ids that are no longs raise; other columns are not read. A very long host is probed once for each of its labels.
    """
    spark = pages.sparkSession
    prepare(spark)
    index = index or build_index(spark, rules, blocked)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, verdict = judge(index, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    host, path = host_and_path(F.col(url_col).cast("string"))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(decide, SCHEMA)
