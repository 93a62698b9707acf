"""SimHash near-duplicates with pigeonring filtering.

64 bits are three segments on a ring. If two fingerprints differ in at most two bits, some segment is the start of a chain
whose cumulative differences keep within the proportional budgets: none in the first segment, one at most in the first two,
two in all three. The second segment then has a half without a difference, so (segment, half of the next) is an exact key:
six keys for each fingerprint. Pairs in a bucket pass the chain check before the full Hamming distance is taken. Other
distances work alike, with one segment more than differing bits.

A bucket of more than BUCKET fingerprints is divided by further segments: the bits that its key leaves open are cut in three,
and of two fingerprints that differ in two bits at most one of the three is equal. Every level leaves fewer open bits; the
last one leaves so few that a bucket cannot hold more than BUCKET different fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, prepare, text_of, written
from graphloom.llm.near_copies import drop_near_copies  # noqa: F401
from graphloom.operators.components import components

WORDS = 3
DISTANCE = 2
#: Fingerprints in one bucket up to which pairs are compared in one task; larger buckets are divided.
BUCKET = 1024
SHINGLES_AT_ONCE = 50_000


def fingerprint(text: str | bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one text: bit i is set if it is set in over half the shingles' XXH64 (seed 42)."""
    data = text.encode() if isinstance(text, str) else text
    tokens = data.translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for a in range(0, n, SHINGLES_AT_ONCE):
        hashes = [xxhash.xxh64_intdigest(joined[x:y], 42) for x, y in zip(first[a : a + SHINGLES_AT_ONCE], last[a : a + SHINGLES_AT_ONCE])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, fp (the fingerprint's bits as a signed long)."""
    prepare(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(make, "doc_id long, fp long")


def bit_counts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, bits) of the ring's segments."""
    return [(int(x[0]), len(x)) for x in np.array_split(np.arange(64), distance + 1)]


def chain_keeps_budget(difference: np.ndarray, start: int, distance: int = DISTANCE) -> np.ndarray:
    """Whether the chain of 1, 2, ... segments from `start` keeps within as many times distance / segments differing bits (rounded down)."""
    total, ok, ring = np.zeros(len(difference), np.int64), np.ones(len(difference), bool), segments(distance)
    for k in range(len(ring)):
        at, bits = ring[(start + k) % len(ring)]
        total += bit_counts((difference >> np.uint64(at)) & np.uint64((1 << bits) - 1))
        ok &= total <= (k + 1) * distance // len(ring)
    return ok


def _first_masks(distance: int) -> list[int]:
    """The bits of each chain's key: a segment, and one half of the next."""
    out, ring = [], segments(distance)
    for start, (at, bits) in enumerate(ring):
        next_at, next_bits = ring[(start + 1) % len(ring)]
        half = next_bits // 2
        for x, y in ((next_at, half), (next_at + half, next_bits - half)):
            out.append(((1 << bits) - 1) << at | ((1 << y) - 1) << x)
    return out


def _next_masks(mask: int, distance: int) -> list[int]:
    """The mask with each of distance + 1 parts of its open bits."""
    open_bits = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in part) for part in np.array_split(open_bits, distance + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(rows: DataFrame, masks: list[int], distance: int, below: Column | None = None) -> DataFrame:
    """fp, chain (the place of a mask in masks), key (the mask's bits of fp); below: the chain whose masks a row gets."""
    if below is None:
        chains = F.explode(F.array(*map(F.lit, range(len(masks)))))
    else:
        chains = F.explode(F.transform(F.array(*map(F.lit, range(distance + 1))), lambda k: (distance + 1) * below + k))
    mask = F.element_at(F.array(*(F.lit(_signed(m)) for m in masks)), F.col("chain") + 1)
    return rows.select("fp", chains.alias("chain")).withColumn("key", F.col("fp").bitwiseAND(mask))


def links(fps: DataFrame, bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """fps: distinct fp. Links u, v that connect the same fingerprints as all pairs within `distance` (1 or more) do."""
    parts = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    masks, out, level = _first_masks(distance), None, 0
    rows = written(_keyed(fps.select("fp"), masks, distance), "buckets")
    while True:
        last = max(64 - m.bit_count() for m in masks) <= np.log2(BUCKET)
        some_large = False
        if not last:
            large = written(rows.groupBy("chain", "key").count().where(F.col("count") > bucket).drop("count"), "large-buckets")
            some_large = not large.isEmpty()
        small = rows.join(large, ["chain", "key"], "left_anti") if some_large else rows
        found = small.repartition(parts, "chain", "key").sortWithinPartitions("chain", "key").select("chain", "key", "fp").mapInArrow(_comparison(len(masks) // (distance + 1), distance), "u long, v long")
        out = found if out is None else out.unionByName(found)
        if not some_large:
            return out
        masks = [m for x in masks for m in _next_masks(x, distance)]
        level += 1
        rows = written(_keyed(rows.join(large, ["chain", "key"], "left_semi"), masks, distance, F.col("chain")), f"buckets-{level}")


def _comparison(chains: int, distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """chains: masks of each segment at this level."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chain, key, fp in _whole_groups(batches):
            a, b = _pairs(chain, key, fp, chains, distance)
            root = _roots(len(fp), a, b)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], names=["u", "v"])

    return compare


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 100_000):
    """Columns chain, key, fp of sorted batches, cut between groups."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            chain, key, fp = _columns(held)
            last = int(np.flatnonzero((chain[1:] != chain[:-1]) | (key[1:] != key[:-1]))[-1]) + 1 if (key != key[-1]).any() or (chain != chain[-1]).any() else 0
            if last:
                yield chain[:last], key[:last], fp[:last]
            tail = pa.RecordBatch.from_arrays([pa.array(x[last:]) for x in (chain, key, fp)], names=["chain", "key", "fp"])
            held, n = [tail], tail.num_rows
    if n:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(3))


def _pairs(chain: np.ndarray, key: np.ndarray, fp: np.ndarray, chains: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one bucket within the distance. Rows are compared at one step after the other, only as far as buckets reach."""
    bits, firsts, seconds = fp.view(np.uint64), [], []
    at = np.arange(len(fp))
    step = 1
    while True:
        at = at[at + step < len(fp)]
        at = at[(chain[at] == chain[at + step]) & (key[at] == key[at + step])]
        if not len(at):
            break
        difference = bits[at] ^ bits[at + step]
        ok = np.zeros(len(at), bool)
        for start in range(distance + 1):
            mine = chain[at] // chains == start
            ok[mine] = chain_keeps_budget(difference[mine], start, distance)
        ok[ok] = bit_counts(difference[ok]) <= distance
        firsts.append(at[ok])
        seconds.append(at[ok] + step)
        step += 1
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *firsts]), np.concatenate([empty, *seconds])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row each row reaches over the pairs: what is emitted is a star, not all pairs."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def near_groups(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at DISTANCE or fewer differing bits; component_id is the smallest doc_id reachable over links. Texts
    without words (null and empty too) have fingerprint zero and link like others. A null id stays null and is no
    component_id unless the component has no other. Repeated rows get a row each; ids that are no longs raise; other columns
    are not read. Shingles of a very long text are hashed SHINGLES_AT_ONCE at a time. An empty table gives an empty result.
    """
    table = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), bucket))
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    moved = written(linked.join(named, "root").select("fp", "component"), "components")
    ids = classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return table.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
