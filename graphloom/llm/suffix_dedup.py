"""Removal of repeated byte strings with suffix arrays made by two-stage sorting.

Sorting the suffixes of a whole corpus in one place does not scale, so the work is divided without loss. Every window of
WINDOW bytes has a minimizer: its anchor of ANCHORS[0] bytes with the least hash. Equal windows have equal minimizers, so all
copies of a window meet under one key. Consecutive windows with one minimizer form a segment. A segment that occurs twice is
repeated as a whole; only segments that share a minimizer with other segments go through a suffix array: suffixes smaller
than their successor are sorted directly, the others are induced by scans over the buckets, and common prefixes of
neighbours say which windows occur twice.

A minimizer of more than GROUP_BYTES (and GROUP_KINDS) of different segments is divided again, by minimizers of longer anchors: those segments
are cut like texts, with the next of ANCHORS. An anchor of WINDOW - 1 bytes leaves one free byte on either side, so that a
group of the last level is bounded, whatever the corpus is. At each level the suffix arrays find the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import prepare, text_of, written

WINDOW = 400
#: Bytes of an anchor at each level, as shares of the window; the last level has one byte less than the window.
ANCHOR = 32
LEVELS = (0.08, 0.72, 0.94)
#: Bits of a minimizer that hold its place while it is chosen: texts of up to 2^PLACE_BITS bytes go in one piece, longer ones in overlapping pieces.
PLACE_BITS = 22
#: Windows from which a segment of periodic text (one minimizer at many places) is cut at the minimizer's next place.
LONGEST_RUN = 4096
#: Bytes whose suffixes are sorted together. A minimizer with more bytes and more kinds of segments than these is divided again;
#: a kind has few times LONGEST_RUN bytes at most, so what is sorted together stays within a few MB.
BLOCK_BYTES = 500_000
GROUP_BYTES, GROUP_KINDS = 250_000, 512
#: The share of all segments from which a kind of them is hot, and that of all kinds from which a minimizer is; at most 1 / HOT_SHARE are,
#: and their rows are not shuffled.
HOT_SHARE = 1 / 10_000
_MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)))


def anchor_sizes(window: int) -> list[int]:
    """The anchors of each level, in multiples of eight bytes, and that of the last."""
    sizes = [max(8, int(window * x) // 8 * 8) for x in LEVELS]
    return [x for x in sizes if x < window - 1] + [window - 1]


def anchors(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """A hash of the `size` (8 or more) bytes from each place on."""
    n = len(data) - size + 1
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    h = np.zeros(n, np.uint64)
    for k, at in enumerate([*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]):
        h += words[at : at + n]
        h *= _MIX[k % 4]
        h ^= h >> np.uint64(31)
    return h


def minimizers(data: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """For each window: the least anchor hash (upper bits) with its place (lower PLACE_BITS); the leftmost of equal ones."""
    place = np.uint64((1 << PLACE_BITS) - 1)
    v = (anchors(data, anchor) & ~place) | np.arange(len(data) - anchor + 1, dtype=np.uint64)
    width, need = 1, window - anchor + 1
    while 2 * width <= need:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (need - width)], v[need - width :]) if need > width else v


def segments(text: bytes, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows, places of the minimizer) of each run of windows with one minimizer.

    In periodic text the same minimizer stands at place after place; the run goes on over them, up to LONGEST_RUN windows or
    the next place behind those.
    """
    size = (1 << PLACE_BITS) - window  # windows of one piece
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(text) - window + 1), size):
        v = minimizers(np.frombuffer(text[at : at + size + window - 1], np.uint8), window, anchor)
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        key = v[first] >> np.uint64(PLACE_BITS)
        run = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        if len(run) < len(first):
            begun = np.repeat(first[run], np.diff(np.append(run, len(first))))
            cut = (first - begun) // LONGEST_RUN
            run = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cut[1:] != cut[:-1]))))
        begins = first[run]
        parts.append((key[run].astype(np.int64), begins + at, np.diff(np.append(begins, len(v))), np.diff(np.append(run, len(first)))))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


def suffix_array(data: bytes, depth: int = WINDOW) -> np.ndarray:
    """The suffixes of data in an order that is right to `depth` bytes; beyond, equal ones stand in any order.

    Two stages. A suffix is small if it is smaller than its successor. Small suffixes are sorted directly. A left-to-right
    scan over the buckets of first bytes then puts each other suffix behind those of its bucket that are there: its
    successor, which is smaller, has been scanned by then.
    """
    t = np.frombuffer(data, np.uint8)
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _smaller_than_successor(t)
    direct = _sorted_directly(data, t, np.flatnonzero(small).astype(np.int32), depth)
    heads = t[direct]
    bounds = np.searchsorted(heads, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[n - 1]].append(np.array([n - 1], np.int32))  # its successor is the empty suffix
    out = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)).tolist():
        layer = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int32)
        bucket = []
        while len(layer):  # within a run of one byte, each suffix induces the one before it
            bucket.append(layer)
            before = layer[layer > 0] - 1
            layer = before[t[before] == c]
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[t[before] > c]
        order = np.argsort(t[before], kind="stable")
        before = before[order]
        first = t[before]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cuts):
            if len(part):
                induced[t[part[0]]].append(part)
    return np.concatenate(out)


def _smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """A suffix is smaller than its successor if the first byte that differs from the next one is smaller; the last is not."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    upto = np.searchsorted(change, np.arange(n))
    out = np.zeros(n, bool)
    inside = upto < len(change)
    at = change[upto[inside]]
    out[inside] = t[at] < t[at + 1]
    return out


def _sorted_directly(data: bytes, t: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """By the first eight bytes at once, then ties one after the other by what follows them."""
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    keys = np.lib.stride_tricks.as_strided(padded, (len(t), 8), (1, 1))[suffixes].copy().view(">u8").ravel()
    order = np.argsort(keys, kind="stable")
    keys, suffixes = keys[order], suffixes[order]
    # past the end the padding looks like zero bytes; such suffixes are ties of what they look like, and slices settle those
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(first[1:], len(keys))
    tied = np.flatnonzero(ends - first > 1)
    for a, b in zip(first[tied].tolist(), ends[tied].tolist()):
        group = suffixes[a:b].tolist()
        group.sort(key=lambda i: data[i : i + depth])
        suffixes[a:b] = group
    return suffixes


def repeated_windows(data: bytes, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """starts: places in data where a window begins. Whether its bytes stand at another of these places too."""
    is_start = np.zeros(len(data), bool)
    is_start[starts] = True
    order = suffix_array(data, window)
    order = order[is_start[order]].astype(np.int64)
    t = np.frombuffer(data, np.uint8)
    rows = np.lib.stride_tricks.as_strided(t, (len(t) - window + 1, window), (1, 1))
    same = np.zeros(max(0, len(order) - 1), bool)
    for a in range(0, len(same), 8192):  # the common prefix of neighbours, as far as a window reaches
        x, y = order[a : a + 8192], order[a + 1 : a + 8193]
        x = x[: len(y)]
        near = np.flatnonzero((rows[x, :16] == rows[y, :16]).all(axis=1))
        same[a + near] = (rows[x[near]] == rows[y[near]]).all(axis=1)
    repeated = np.zeros(len(data), bool)
    repeated[order[:-1][same]] = True
    repeated[order[1:][same]] = True
    return repeated[starts]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each run of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


KEY = ["k1", "k2", "k3"]
KIND = ["minimizer", "d1", "d2"]
SEGMENT_ROWS = "k1 long, k2 long, k3 long, weight long, minimizer long, d1 long, d2 long, first int, windows int, alone boolean"


def _digests(parts: list[bytes]) -> np.ndarray:
    """128 bits of a cryptographic hash for each, as two longs: equal ones stand for equal bytes."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in parts), "<i8").reshape(-1, 2)


def _segment_rows(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """texts: KEY, weight, text (binary). alone: whether the segment may hold a repeat all by itself."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, found = [], []
            for i, data in enumerate(batch.column(4).to_pylist()):
                m, first, n, places = segments(data, window, anchor)
                if len(m):
                    rep.append(np.full(len(m), i))
                    digest = _digests([data[a : a + k + window - 1] for a, k in zip(first.tolist(), n.tolist())])
                    found.append((m, digest[:, 0], digest[:, 1], first.astype(np.int32), n.astype(np.int32), places > 1))
            if found:
                at = pa.array(np.concatenate(rep))
                columns = [*(batch.column(c).take(at) for c in range(4)), *(pa.array(np.concatenate(x)) for x in zip(*found))]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "weight", *KIND, "first", "windows", "alone"])

    return texts.select(*KEY, "weight", "text").mapInArrow(cut, SEGMENT_ROWS)


def _shared_kinds(kinds: DataFrame, window: int, group_bytes: int, group_kinds: int, level: int, least: float) -> DataFrame:
    """The kinds in which repeats are still to be found, with large: whether their minimizer is divided again.

    A minimizer with `least` or more kinds is hot; its kinds stay where they are and are not shuffled.
    """
    last = level + 1 == len(anchor_sizes(window))
    size = F.sum(F.col("windows").cast("long") + window - 1)
    # nothing is left to find under a minimizer whose segments all occur twice
    some = F.max(F.col("alone") & (F.col("copies") == 1))
    counted = kinds.groupBy("minimizer").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("least"), some.alias("some"), size.alias("bytes"))
    large = F.lit(False) if last else (F.col("bytes") > group_bytes) & (F.col("kinds") > group_kinds)
    counted = counted.select("minimizer", large.alias("large"), F.expr("least = 1 AND (kinds > 1 OR some)").alias("shared"), (F.col("kinds") >= least).alias("hot"))
    counted = written(counted.where("shared OR hot"), f"minimizers-{level}")
    hot = counted.where("hot").drop("hot")  # 1 / HOT_SHARE rows at most
    rest = kinds.join(F.broadcast(hot.select("minimizer")), "minimizer", "left_anti").join(counted.where("NOT hot").select("minimizer", "large"), "minimizer")
    return kinds.join(F.broadcast(hot.where("shared").drop("shared")), "minimizer").unionByName(rest)


def _segment_bytes(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted: one place for each segment. KIND, large, bytes. A text's list of them takes less room than the text."""
    places = wanted.groupBy(*KEY).agg(F.collect_list(F.struct(*KIND, "large", "first", "windows")).alias("wanted"))
    joined = texts.join(places, KEY).select("text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(w["minimizer"], w["d1"], w["d2"], w["large"], data[w["first"] : w["first"] + w["windows"] + window - 1]) for w in items]
            *keys, large, b = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(large, pa.bool_()), pa.array(b, pa.binary())], names=[*KIND, "large", "bytes"])

    return joined.mapInArrow(cut, "minimizer long, d1 long, d2 long, large boolean, bytes binary")


RUN_ROWS = "minimizer long, d1 long, d2 long, start int, stop int"


def _by_suffix_arrays(parts: DataFrame, window: int) -> DataFrame:
    """parts: KIND, bytes. The runs of a segment's bytes that repeated windows cover."""
    n = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[-1][0] and size >= BLOCK_BYTES:
                    yield held
                    held, size = [], 0
                if not held or row[:3] != held[-1][:3]:  # repeated rows bring a segment more than once
                    held.append(row)
                    size += len(row[3])
        if held:
            yield held

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sizes = np.array([len(x[3]) for x in block])
            at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            counts = sizes - window + 1
            starts = np.repeat(at, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            flags = repeated_windows(b"".join(x[3] for x in block), starts, window)
            out, k = [], 0
            for (*kind, _), n_windows in zip(block, counts.tolist()):
                out += [(*kind, int(a), int(b) + window - 1) for a, b in zip(*_runs(flags[k : k + n_windows]))]
                k += n_windows
            columns = zip(*out) if out else ((),) * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*KIND, "start", "stop"])

    return parts.repartition(n, "minimizer").sortWithinPartitions(*KIND).mapInArrow(sort, RUN_ROWS)


def covered(texts: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, group_kinds: int = GROUP_KINDS, level: int = 0) -> DataFrame:
    """texts: KEY, weight (how often it occurs), text (binary). KEY, a, b: spans of it under windows that occur twice.

    Spans may overlap. Texts with one key have to be equal; they are as many places as they are rows.
    """
    sizes = anchor_sizes(window)
    last = level + 1 == len(sizes)
    found = written(_segment_rows(texts, window, sizes[level]), f"segments-{level}")
    place = F.struct(*KEY, "first", "windows", "alone")
    kinds = found.groupBy(*KIND).agg(F.sum("weight").alias("copies"), F.min(place).alias("place"))
    kinds = written(kinds.select(*KIND, "copies", "place.*"), f"segment-kinds-{level}")
    least = max(100, HOT_SHARE * kinds.count())
    wanted = _shared_kinds(kinds, window, group_bytes, group_kinds, level, least)
    parts = written(_segment_bytes(texts, wanted, window), f"segment-bytes-{level}")
    runs = _by_suffix_arrays(parts.where("NOT large").drop("large"), window)
    large_parts = parts.where("large")
    if not last and not large_parts.isEmpty():
        own = large_parts.groupBy(*KIND).agg(F.first("bytes").alias("text")).join(kinds.select(*KIND, "copies"), KIND)
        own = own.select(*(F.col(k).alias(to) for k, to in zip(KIND, KEY)), F.col("copies").alias("weight"), "text")
        below = covered(written(own, f"large-segments-{level}"), window, group_bytes, group_kinds, level + 1)
        runs = runs.unionByName(below.select(*(F.col(k).alias(to) for k, to in zip(KEY, KIND)), F.col("a").alias("start"), F.col("b").alias("stop")))
    runs = written(runs, f"runs-{level}")
    whole = kinds.where("copies > 1").select(*KIND, F.lit(0).alias("start"), (F.col("windows") + window - 1).alias("stop"), "copies")
    part = runs.join(kinds.where("copies = 1").select(*KIND), KIND).select(*KIND, "start", "stop")
    # at deeper levels, what occurs more than once has its spans already
    once = found.where("weight = 1").select(*KEY, *KIND, "first")
    least = max(100, HOT_SHARE * kinds.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    hot = written(whole.where(F.col("copies") >= least).drop("copies"), f"hot-kinds-{level}")  # 1 / HOT_SHARE rows at most
    rest = whole.where(F.col("copies") < least).drop("copies").unionByName(part)
    spans = once.join(F.broadcast(hot), KIND).unionByName(once.join(F.broadcast(hot.select(*KIND)), KIND, "left_anti").join(rest, KIND))
    return spans.select(*KEY, (F.col("first") + F.col("start")).alias("a"), (F.col("first") + F.col("stop")).alias("b"))


def _row_key(id_col: str) -> list[Column]:
    """What tells rows apart that have different texts; repeated rows get one key, and one answer holds for all of them."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"), F.xxhash64("text", F.lit(1)).alias("k3")]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, group_bytes: int = GROUP_BYTES, group_kinds: int = GROUP_KINDS) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text: kept (binary) too.

    A byte goes if a string of `window` (16 or more) bytes that starts anywhere else too, in this text or another, covers it.
    Matches do not cross texts; null is empty. Repeated rows count as places of their own, so long ones lose all. A null id
    stays null, ids that are no longs raise; other columns are not read. A cut may fall inside a character, so kept bytes need
    not be UTF-8. A very long text is cut into segments in pieces of 4 MB; periodic text gives a segment for every LONGEST_RUN
    bytes, other text one for about 190. A text of up to 2 GB (Spark's bound of a string) is one row at the start and the end.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    keyed = rows.select(*_row_key("doc_id"), F.lit(1).cast("long").alias("weight"), "text")
    spans = covered(keyed, window, group_bytes, group_kinds)
    # a text's spans take less room than the text: 8 bytes for each segment or run in it; repeated rows have equal ones, and a set keeps one
    spans = spans.groupBy(*KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    whole_rows = rows.select("doc_id", *_row_key("doc_id"), "text").join(spans, KEY, "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                removed = _union(items or [])
                at, kept = 0, []
                for a, b in removed:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) or [()] * 5
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            made = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds_))]
            yield pa.RecordBatch.from_arrays(made if with_text else made[:-1], names=names if with_text else names[:-1])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return whole_rows.mapInArrow(cut, schema)


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the spans."""
    out: list[list[int]] = []
    for s in sorted((s["a"], s["b"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]
