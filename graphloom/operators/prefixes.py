"""Which sets may be similar, found in the tasks: rare tokens lay the sets out, places and bitmaps sort the pairs out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Buckets of tokens that are counted: a table of fixed size, whatever the input.
BUCKETS = 1 << 20
#: Words of 64 bits of a set's bitmap.
WORDS = 4
#: Sets of one token that are one group; more are cut into blocks, and groups are of two blocks.
GROUP = 16_384
#: Pairs of one step, and rows that are looked at together.
STEP = 2_000_000
ROWS = 200_000
#: What laid_out() gives.
LAID = "key long, no long, n int, place int, side int, " + ", ".join(f"w{k} long" for k in range(WORDS))


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(20)).astype(np.int64) % BUCKETS


def bitmaps(tokens: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """tokens: of all sets, one set after the other. A bit is set if it has an odd number of tokens: two sets that differ in d tokens differ in d bits at most."""
    bit = np.left_shift(np.uint64(1), tokens.view(np.uint64) & np.uint64(63))
    word = (tokens.view(np.uint64) >> np.uint64(6)) % np.uint64(WORDS)
    return [np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), first).view(np.int64) for k in range(WORDS)]


def laid_out(counts: np.ndarray, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: no, hashes (of the tokens; not empty). Each set's rarest tokens with its size, their places and its bitmap.

    Tokens are in order of their bucket's count, then hash. Two sets that are similar enough share one of the first
    n - ceil(least * n) + 1 of each; tokens alone in their bucket have a place, but no row.
    """
    for batch in (whole.slice(a, 5_000) for whole in batches for a in range(0, whole.num_rows, 5_000)):
        n = pc.list_value_length(batch.column("hashes")).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = pc.list_flatten(batch.column("hashes")).to_numpy(zero_copy_only=False)
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), n)
        words = bitmaps(tokens, first)
        count = counts[bucket(tokens)]
        order = np.lexsort((tokens, count, of))
        tokens, count = tokens[order], count[order]
        place = np.arange(len(tokens)) - first[of] + 1
        row = np.flatnonzero((place <= n[of] - np.ceil(n[of] * least - 1e-9) + 1) & (count > 1))
        # rows of a frequent token go to the groups of their block with each other block
        blocks = -(-count[row].astype(np.int64) // GROUP)
        no = batch.column("no").to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(row)), blocks)
        other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        row, blocks = row[at], blocks[at]
        own = no[of[row]] % blocks
        low, high = np.minimum(own, other), np.maximum(own, other)
        key = tokens[row].view(np.uint64) + (low * blocks + high).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        side = np.where(own == other, 0, np.where(own < other, 1, 2))
        columns = [key.view(np.int64), no[of[row]], n[of[row]].astype(np.int32), place[row].astype(np.int32), side.astype(np.int32), *(w[of[row]] for w in words)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "no", "n", "place", "side", *(f"w{k}" for k in range(WORDS))])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of about ROWS rows, cut between keys."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= ROWS:
            rows = [np.concatenate(c) for c in zip(*held)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield [c[:last] for c in rows]
            held, n = [[c[last:] for c in rows]], n - last
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def likely_pairs(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: rows of laid_out() in order of key. a < b of sets that may be similar enough; a pair may come from several keys.

    Of similar sets, the first common token has enough tokens behind it in both, and their bitmaps differ in few bits.
    """
    for key, no, n, place, side, *words in _groups(batches):
        later = np.searchsorted(key, key, side="right") - np.arange(len(key)) - 1
        ends, start = np.cumsum(later), 0
        while start < len(key):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + STEP, side="right")))
            some = later[start:stop]
            a = np.repeat(np.arange(start, stop), some)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some)
            shared = np.ceil((n[a] + n[b]) * (least / (1 + least)) - 1e-9).astype(np.int64)
            fit = (1 + np.minimum(n[a] - place[a], n[b] - place[b]) >= shared) & ((side[a] == 0) | (side[a] != side[b])) & (no[a] != no[b])
            a, b, shared = a[fit], b[fit], shared[fit]
            apart = sum(np.bitwise_count((w[a] ^ w[b]).view(np.uint64)).astype(np.int64) for w in words)
            near = apart <= n[a] + n[b] - 2 * shared
            pairs = np.unique(np.stack([np.minimum(no[a[near]], no[b[near]]), np.maximum(no[a[near]], no[b[near]])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
            start = stop
