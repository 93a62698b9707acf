"""Near copies by 5-word shingles: pairs with Jaccard 0.8 or more, found by SimHash and by prefix filtering, confirmed exactly.

First the fingerprints of simhash.py, over the same shingles, are linked by pigeonring within DISTANCE bits, and these links are
confirmed. At Jaccard 0.8 two texts differ in 10 bits of 64 or so, and up to 16, a radius within which pigeonring has no selective
keys; what fingerprints leave apart is therefore found by prefix filtering, which loses no pair.

Shingles have one order for all texts: those that are frequent in a sample come last, others by hash. Two sets that are
similar enough share one of the first n - ceil(0.8 n) + 1 of each, whatever the order is, so no pair is lost. A pair that meets
only in frequent shingles must have so many of them that all it needs may be frequent; other pairs meet in a rare shingle.
In a bucket of a shared shingle all members are compared to a leader, in each round to another one; members that are in
different components after that are compared in pairs inside one task, first on bitmaps: the parities of two sets' hashes differ
in no more bits than the sets have elements apart. Those with a partner by bitmaps get their sets, and the links that join what is
apart are all that a bucket gives, so a large group costs rows for each member, not for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, given_back, map_shipped, prepare, ship_arrays, shuffles_freed, small_batches, text_of, unused, written
from graphloom.operators.components import components
from graphloom.storage import discard

WORDS = 5
LEAST = 0.8
#: Texts of the sample that says which shingles are frequent, texts of it that one must be in, and how many there may be. They
#: change how many candidates there are, not the result.
SAMPLE, FREQUENT, MOST_FREQUENT = 10_000, 4, 100_000
#: Bits in which linked fingerprints differ at most: a key has 24 bits then.
DISTANCE = 3
#: Rounds in which each bucket has a leader that all others are compared to, before what is still apart is compared in pairs.
LEADERS = 2
#: Rows of a bucket that are compared in pairs at a time, and shingles that they have together, about.
BLOCK, BLOCK_SHINGLES = 2048, 500_000
#: Bytes of an Arrow batch, about; one longer text or set stands alone.
BATCH_BYTES = 4 << 20


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's runs of words, sorted; a text with fewer words is one run."""
    tokens = text.encode().translate(LOWER).split()
    n = max(1, len(tokens) - words + 1)
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens[i : i + words])) for i in range(n)], np.uint64))


def needed(n: int, least: float) -> int:
    """Shingles that a set of n shares with any other that is similar enough."""
    return math.ceil(least * n - 1e-9)


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(text_of(text_col), 256))


def _frequent(docs: DataFrame, words: int, text_col: str) -> np.ndarray:
    """Hashes of shingles that are in several texts of a sample, sorted."""

    @given_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [shingles(t, words) for batch in batches for t in batch.column(0).to_pylist()]
        if held:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(counts[some])], names=["h", "n"])

    share = min(1.0, SAMPLE / max(1, docs.count()))
    counted = docs.select(text_of(text_col).alias("text")).sample(share, 1).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The parity of the hashes that fall on each bit; as many bits as hashes, or up to twice as many."""
    bits = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    counts = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<u8")


def bits_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two bitmaps differ; the longer one is folded, which keeps parities."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


NODE_ROWS = "digest binary, fp long, n int, frequent int, prefix array<long>, prefix_frequent array<long>, bits binary"


def _nodes(docs: DataFrame, words: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """A row for each different text: node (a number), digest, fp (the fingerprint), least (the smallest id), n, frequent (how many shingles are), prefixes (hashes), bits."""
    from graphloom.llm.simhash import fingerprint  # it imports this module

    frequent = ship_arrays(docs.sparkSession, "frequent-shingles", keys=_frequent(docs, words, text_col))

    @given_back
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = map_shipped(frequent)["keys"]
        for batch in batches:
            rows = []
            for t in batch.column(2).to_pylist():
                s = shingles(t, words)
                hit = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                rare, often = s[~hit].view(np.int64), s[hit].view(np.int64)
                size = len(s) - needed(len(s), least) + 1
                rows.append((np.uint64(fingerprint(t, words)).view(np.int64), len(s), len(often), rare[:size], often[: max(0, size - len(rare))], bitmap(s).tobytes()))
            fp, n, f, prefix, more, bits = zip(*rows) if rows else ((),) * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, k) for x, k in zip((fp, n, f, prefix, more, bits), kinds))], names=["id", "digest", "fp", "n", "frequent", "prefix", "prefix_frequent", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    # of equal texts one row goes on: the smallest id's
    one = docs.groupBy(_digest(text_col).alias("digest")).agg(F.min(id_col).alias("id"), F.first(text_of(text_col)).alias("text"))
    rows = one.select("id", "digest", "text").mapInArrow(make, f"id {kind}, {NODE_ROWS}")
    return written(rows.withColumnRenamed("id", "least").withColumn("node", F.monotonically_increasing_id()), "shingle-prefixes")


def _pair_join(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """pairs u, v with the column of both as _a and _b."""
    side = lambda x, name: rows.select(F.col("node").alias(x), F.col(column).alias(name))
    return pairs.join(side("u", "_a"), "u").join(side("v", "_b"), "v").select("u", "v", "_a", "_b")


def _plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """pairs: distinct u, v, n_u, n_v. Those whose bitmaps don't rule them out; written."""
    sized = nodes.select("node", F.struct("n", "bits").alias("x"))

    @given_back
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = batch.columns
            ok = []
            for x, y in zip(a.to_pylist(), b.to_pylist()):
                both = x["n"] + y["n"]
                ok.append(bits_apart(np.frombuffer(x["bits"], "<u8"), np.frombuffer(y["bits"], "<u8")) <= both - 2 * needed(both, least / (1 + least)))
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return written(_pair_join(pairs, sized, "x").mapInArrow(compare, "u long, v long"), "plausible-pairs")


def _sets(some: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, text_col: str) -> DataFrame:
    """some: distinct node. node, tokens: all shingles of their texts; written."""

    @given_back
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "tokens"])

    ends = written(nodes.select("node", "digest").join(some, "node", "left_semi"), "pair-ends")
    texts = docs.select(_digest(text_col).alias("digest"), text_of(text_col).alias("text")).join(ends, "digest").select("node", "text").dropDuplicates(["node"])
    sets = written(texts.mapInArrow(tokens, "node long, tokens binary"), "shingle-sets")
    discard(ends)
    return sets


def near(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have Jaccard >= least."""
    if len(x) > len(y):
        x, y = y, x
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return shared >= least * (len(x) + len(y) - shared) - 1e-9


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, least: float, text_col: str) -> DataFrame:
    """pairs: u, v, written. Those with Jaccard >= least, by all shingles of their texts; written."""

    @given_back
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = batch.columns
            ok = [near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(a.to_pylist(), b.to_pylist())]
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    if pairs.isEmpty():
        return pairs
    sets = _sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), docs, nodes, words, text_col)
    out = written(_pair_join(pairs, sets, "tokens").mapInArrow(compare, "u long, v long"), "near-links")
    discard(sets)
    return out


def _fingerprint_pairs(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs u, v that connect the same nodes as all pairs of fingerprints within the distance do; written.

    Of each fingerprint one node stands for all; the others are paired with it.
    """
    from graphloom.llm.simhash import links

    first = written(nodes.groupBy("fp").agg(F.min("node").alias("u")), "fingerprints")
    same = nodes.join(first, "fp").where("node <> u").select("u", F.col("node").alias("v"))
    found = links(first.select("fp"), distance=distance).distinct().withColumnsRenamed({"u": "fp_u", "v": "fp_v"})
    named = lambda x: first.select(F.col("fp").alias(f"fp_{x}"), F.col("u").alias(x))
    other = found.join(named("u"), "fp_u").join(named("v"), "fp_v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return written(same.unionByName(other), "fingerprint-pairs")


def _links(docs: DataFrame, nodes: DataFrame, words: int, least: float, text_col: str) -> DataFrame:
    """Links u, v that connect the same nodes as all pairs with Jaccard >= least do."""
    entry = lambda column, often: nodes.select("node", "n", F.when(F.lit(often), F.col("frequent")).alias("f"), F.explode(column).alias("h"))
    rows = entry("prefix", False).unionByName(entry("prefix_frequent", True))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    links = _confirmed(_plausible(_fingerprint_pairs(nodes), nodes, least), docs, nodes, words, least, text_col)

    def still_mixed(rows: DataFrame) -> DataFrame:
        """rows with the roots by the links so far; buckets of one root are left out."""
        roots = components(links).select("node", F.col("root").alias("to"))
        now = rows.join(roots, "node", "left").withColumn("root", F.coalesce("to", "node")).drop("to")
        mixed = now.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
        return written(now.join(mixed, "h", "left_semi"), "mixed-buckets")

    every = written(rows.join(shared, "h"), "shared-shingles")
    left = still_mixed(every)
    discard(every)

    def may(u: str, v: str) -> Column:
        n_u, n_v = F.col(f"n_{u}"), F.col(f"n_{v}")
        wanted = F.ceil((n_u + n_v) * (least / (1 + least)) - 1e-9)
        sizes = F.least(n_u, n_v) >= least * F.greatest(n_u, n_v) - 1e-9
        return sizes & (F.col(f"f_{u}").isNull() | (F.least(F.col(f"f_{u}"), F.col(f"f_{v}")) >= wanted)) & (F.col(f"root_{u}") != F.col(f"root_{v}"))

    side = lambda df, x: df.select("h", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "f", "root")])
    ordered = lambda pairs: pairs.where(may("u", "v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    for k in range(LEADERS):
        if left.isEmpty():
            return links
        # buckets with the same members get different leaders, so that their stars together reach far
        leader = left.groupBy("h").agg(F.min_by(F.struct("node", "n", "f", "root"), F.xxhash64("node", "h", F.lit(k))).alias("x")).select("h", "x.*")
        tried = _plausible(ordered(side(left, "u").join(side(leader, "v"), "h")), nodes, least)
        links = written(links.unionByName(_confirmed(tried, docs, nodes, words, least, text_col)), "links-so-far")
        before, left = left, still_mixed(left.drop("root"))
        discard(before)
    members = written(_plausible_in_buckets(left, nodes, least, ends=True), "plausible-members")
    return links.unionByName(_linked_in_buckets(members, docs, nodes, words, least, text_col))


def _plausible_in_buckets(rows: DataFrame, nodes: DataFrame, least: float, block: int = BLOCK, ends: bool = False) -> DataFrame:
    """rows: h, node, n, f, root. Pairs u < v of different roots in a bucket that sizes, frequent shingles and bitmaps don't rule out.

    ends: not the pairs, but h, i, j (the group), node, root of rows that are in one, each once. Pairs are compared in arrays. A
    bucket of more than `block` rows or BLOCK_SHINGLES shingles is cut into blocks; each pair of blocks is a group of its own, so no task has a large bucket.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)
    blocks = rows.groupBy("h").agg(F.ceil(size).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    laid = rows.join(blocks, "h").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = laid.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", F.coalesce("f", F.lit(-1)).alias("f"), "root").join(nodes.select("node", "bits"), "node")
    ordered = keyed.select("h", "i", "j", "own", "node", "n", "f", "root", "bits").repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j")

    @given_back
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _groups(batches):
            node, root = (np.array([r[k] for r in held], np.int64) for k in (1, 4))
            pairs = _pairs_of(held, key[1] != key[2], least)
            if ends:
                hit = np.zeros(len(held), bool)
                for k, others in pairs:
                    hit[others] = True
                    hit[k] |= len(others) > 0
                m = int(hit.sum())
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(m, x), t) for x, t in zip(key, (pa.int64(), pa.int32(), pa.int32()))), pa.array(node[hit]), pa.array(root[hit])], names=["h", "i", "j", "node", "root"])
            else:
                for k, others in pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[others], node[k])), pa.array(np.maximum(node[others], node[k]))], names=["u", "v"])

    return ordered.mapInArrow(compare, "h long, i int, j int, node long, root long" if ends else "u long, v long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The key (the first three columns) and the other columns' rows of each group; batches come sorted by it."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:3] != key:
                yield key, held
                held = []
            key = row[:3]
            held.append(row[3:])
    if held:
        yield key, held


def _linked_in_buckets(members: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, least: float, text_col: str) -> DataFrame:
    """members: h, i, j, node, root, written. Links u, v that connect what pairs with Jaccard >= least in a group do; written.

    Of groups with the same members one is compared (they are the same if their numbers and two sums of 64-bit hashes are).
    A pair whose ends are connected by then is not compared, so a group gives fewer links than it has members.
    """
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    alike = members.groupBy("h", "i", "j").agg(F.count(F.lit(1)).alias("m"), *sums).groupBy("m", "s0", "s1")
    one = alike.agg(F.min(F.struct("h", "i", "j")).alias("x")).select("x.*")
    some = written(members.join(one, ["h", "i", "j"], "left_semi"), "compared-members")
    discard(members)
    sets = _sets(some.select("node").distinct(), docs, nodes, words, text_col)

    @given_back
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches):
            tokens = [np.frombuffer(r[2], np.uint64) for r in held]
            rows = [(0, node, len(t), -1, root, bitmap(t).tobytes()) for (node, root, _), t in zip(held, tokens)]
            root, u, v = np.array([r[1] for r in held], np.int64), [], []
            for k, others in _pairs_of(rows, False, least):
                for x in others.tolist():
                    if root[x] != root[k] and near(tokens[k], tokens[x], least):
                        u.append(held[k][0])
                        v.append(held[x][0])
                        root[root == root[x]] = root[k]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    ordered = some.join(sets, "node").select("h", "i", "j", "node", "root", "tokens").repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j")
    out = written(ordered.mapInArrow(link, "u long, v long"), "near-links")
    discard(some)
    discard(sets)
    return out


def _pairs_of(rows: list[tuple], two_blocks: bool, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """rows: block, node, n, f (-1: none), root, bits. Of two blocks, pairs between them; of one, all pairs in it: a place, and those of its partners."""
    own, _, n, f, root = (np.array(x, np.int64) for x in zip(*(r[:5] for r in rows)))
    maps = [np.frombuffer(r[5], "<u8") for r in rows]
    size = np.array([len(m) for m in maps])
    for small in np.unique(size).tolist():
        left = np.flatnonzero(size == small)
        right = np.flatnonzero(size >= small)
        folded = np.stack([np.bitwise_xor.reduce(maps[k].reshape(-1, small), axis=0) for k in right.tolist()])
        for k in left.tolist():
            total = n[k] + n[right]
            ok = (root[right] != root[k]) & (np.minimum(n[right], n[k]) >= least * np.maximum(n[right], n[k]) - 1e-9)
            ok &= (size[right] > small) | (right > k)
            if two_blocks:
                ok &= own[right] != own[k]
            wanted = np.ceil(total * (least / (1 + least)) - 1e-9)
            ok &= (f[k] < 0) | (np.minimum(f[right], f[k]) >= wanted)
            some = np.flatnonzero(ok)
            apart = np.bitwise_count(folded[some] ^ maps[k]).sum(axis=1, dtype=np.int64)
            yield k, right[some[apart <= total[some] - 2 * wanted[some]]]


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs with one row of each group of near copies, that with the smallest id (null ids last); all columns stay.

    Texts link if the Jaccard similarity of their word shingles (A-Z in lower case) is `least` or more; groups are what links
    connect. Each row has its own verdict: of repeated rows one stays, and an id that is in several groups may stay in each. Null
    texts are empty, and empty ones are copies of each other; a text of fewer words is one shingle; texts of any length are whole;
    an empty table stays empty.
    """
    prepare(docs.sparkSession)
    with shuffles_freed(docs.sparkSession), small_batches(docs.sparkSession, BATCH_BYTES):
        nodes = _nodes(docs, words, least, id_col, text_col)
        roots = components(_links(docs, nodes, words, least, text_col)).select("node", "root")
    grouped = nodes.select("node", "least", "digest").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    first = grouped.agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "digest")).alias("x"))
    own, kept_id, kept, place = (unused(docs.columns, x) for x in ("_own_digest", "_kept_id", "_kept_digest", "_place"))
    stays = first.select(F.col("x.least").alias(kept_id), F.col("x.digest").alias(kept))
    marked = docs.withColumn(own, _digest(text_col))
    found = marked.join(stays, (F.col(own) == F.col(kept)) & F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    return found.withColumn(place, F.row_number().over(Window.partitionBy(own, id_col).orderBy(F.lit(1)))).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
