"""Language-model scores: an interpolated modified Kneser-Ney trigram model counted in Spark.

Counts are made in four steps. Words: each task counts hashes of its words; parts of the hash range are summed and written
as sorted hash arrays, and a word's number is its rank in them. Trigrams: each task counts its triples of word numbers; parts
(by the two context words) are summed, written as sorted hash arrays, and add up what they have for each context and for each
pair of last words. Pairs: these sums meet and become arrays too. Words again: what the pairs have for every word meets by its
number. Workers memory-map the arrays and look up a batch's keys together. Rows that are shuffled are blocks of sorted keys,
one for each task and part; nothing but sums and the few hottest words reaches the driver.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, by_bytes, fresh_path, give_back, mounted, prepare, shared_map, shared_save, shuffles_freed, small_batches, text_of, written

#: The end token's hash is that of a string no word can be.
END = xxhash.xxh3_64_intdigest(b"\n")
BATCH_BYTES = 2_500_000
#: Tokens that a task counts before it sends a block of words or triples, and words that a worker remembers.
BLOCK_TOKENS, BLOCK_TRIPLES = 2_000_000, 1_000_000
REMEMBERED = 200_000
#: Bytes at which an Arrow batch of blocks is full: those of a task are not to be in memory together, in the JVM or in Python.
BLOCK_BATCH_BYTES = 4_000_000
#: Keys that are hashed at a time, so that what comes between stays small.
HASHED = 1 << 17
#: Bytes of training text for which there is a part at least, so that a part fits a worker's memory.
PART_BYTES = 256_000_000
#: Words of each part of the hash range that are reported as its most frequent. Of these, words with more than a quarter of a
#: part's share of tokens are hot: contexts of two hot words are dealt out by the third word too.
HOTTEST = 64
#: Discounts where the counts of counts are too few to estimate them.
DEFAULT_DISCOUNTS = (0.7, 1.1, 1.4)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0xC2B2AE3D27D4EB4F)
WORD_BLOCK = "part int, keys binary, counts binary"
TRIPLE_BLOCK = "part int, keys binary, sizes binary, words binary, counts binary"
PAIR_BLOCK = "part int, kind int, keys binary, counts binary, sums array<long>"
NUMBER_BLOCK = "part int, keys binary, counts binary, sums array<long>"


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the sums that hold for all of them."""

    path: str
    parts: int
    vocabulary: int
    tokens: int
    bases: tuple[int, ...]  # the number of the first word of each part
    step: int  # words of a part of the table by number
    pairs: int
    discounts: tuple[tuple[float, float, float], ...]  # of trigrams, pairs and words
    unigram_gamma: float
    hot: tuple[int, ...]
    there: dict[str, frozenset[int]]  # the parts that were written; a file of them that is missing is an error


def tokens_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


def hash_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of a 64-bit hash: parts are equal ranges of it, by the upper 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def mix(keys: np.ndarray) -> np.ndarray:
    h = keys * _SPREAD
    h ^= h >> np.uint64(29)
    h *= _AGAIN
    return h ^ (h >> np.uint64(32))


def triple_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context) + word.astype(np.uint64))


def _by_pieces(function, kind: type, *columns: np.ndarray) -> np.ndarray:
    """function of long columns, HASHED rows at a time."""
    out = np.empty(len(columns[0]), kind)
    for a in range(0, len(out), HASHED):
        out[a : a + HASHED] = function(*(c[a : a + HASHED] for c in columns))
    return out


def triple_part(context: np.ndarray, hashes: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """By the context; where that is two hot words, by the whole triple."""
    return hash_part(np.where(hot, hashes, mix(context)), parts)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their differences, as few for each as the largest needs; first the lowest bytes of all."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(steps[1:].max(initial=0)).bit_length() // 8))
    body = steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + keys[:1].tobytes() + body.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.zeros(1 + (len(data) - 9) // width, np.uint64)
    steps[0] = np.frombuffer(data, "<u8", 1, 1)[0]
    rest = steps[1:].view(np.uint8).reshape(-1, 8)
    rest[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1).T
    return np.cumsum(steps, dtype=np.uint64)


def hash_array(hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hashes as an array: the upper bits say where a bucket of about eight starts, the 32 bits behind them are kept.

    Two keys are taken for one with a chance of about eight in 2^32, however large the corpus is.
    """
    bits = max(1, int(len(hashes) // 8).bit_length())
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return {"starts": np.concatenate(([0], np.cumsum(counts))).astype("<u4"), "rest": ((hashes << np.uint64(bits)) >> np.uint64(32)).astype("<u4")}


def find(table: dict[str, np.ndarray], hashes: np.ndarray, name: str = "") -> np.ndarray:
    """Places of hashes in an array, -1 where there is none: a binary search in the buckets of all at once."""
    starts, kept = (np.asarray(table[f"{name}{x}"]) for x in ("starts", "rest"))
    if not len(kept):
        return np.full(len(hashes), -1, np.int64)
    bits = (len(starts) - 1).bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    want = ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    at, high = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
    step = 1 << int((high - at).max(initial=0)).bit_length()
    at -= 1  # the last place that is known to hold less
    while step := step >> 1:
        probe = at + step
        np.copyto(at, probe, where=(probe < high) & (kept.take(probe, mode="clip") < want))
    at += 1
    return np.where((at < high) & (kept.take(at, mode="clip") == want), at, -1)


def narrow(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Values in a byte each; those of 255 and more beside them."""
    large = np.flatnonzero(values > 254)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}_at": large, f"{name}_of": values[large].astype(np.int64)}


def widen(table: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = table[name][at].astype(np.int64)
    if len(table[f"{name}_at"]):
        big = np.flatnonzero(out == 255)
        out[big] = table[f"{name}_of"][np.searchsorted(table[f"{name}_at"], at[big])]
    return out


def _small(part: np.ndarray) -> np.ndarray:
    """Parts in as few bits as they need; those of 16 bits are sorted without comparisons."""
    return part.astype(np.uint16 if len(part) and int(part.max()) < 1 << 16 else np.uint32)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows of equal sorted columns begin."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """The blocks of each part in turn; batches come sorted by part. One part's blocks are in memory together."""
    part, held = None, []
    for batch in batches:
        for p, *columns in ([c[i].as_py() for c in batch.columns] for i in range(batch.num_rows)):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append(columns)
    if held:
        yield part, held


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    columns = zip(*rows) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _summed(blocks: list[tuple[bytes, bytes]], kind: str = "<u4", width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys, and the sums of their `width` counts (rows of a matrix). Takes the blocks out of their list."""
    size = np.dtype(kind).itemsize * width
    end = sum(len(c) // size for _, c in blocks)
    keys, counts = np.empty(end, np.uint64), np.empty((width, end), kind)
    while blocks:
        k, c = blocks.pop()
        at, end = end, end - len(c) // size
        keys[end:at], counts[:, end:at] = unpack_keys(k), np.frombuffer(c, kind).reshape(width, -1)
    order = np.argsort(keys)
    keys = keys[order]
    first = _starts(keys)
    keys = keys[first]
    sums = np.empty((width, len(first)), np.int64)
    if len(first):
        for row, out in zip(counts, sums):
            np.add.reduceat(row[order], first, dtype=np.int64, out=out)
    return keys, sums


def _triples(blocks: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and counts of all blocks, which are taken out of their list. width: bytes of a word's number."""
    end = sum(len(c) // 4 for *_, c in blocks)
    context, word, counts = np.empty(end, np.uint64), np.zeros((end, 4), np.uint8), np.empty(end, np.uint32)
    while blocks:
        keys, sizes, body, c = blocks.pop()
        at, end = end, end - len(c) // 4
        context[end:at] = np.repeat(unpack_keys(keys), np.frombuffer(sizes, "<u4"))
        word[end:at, :width] = np.frombuffer(body, np.uint8).reshape(width, -1).T
        counts[end:at] = np.frombuffer(c, "<u4")
    return context, word.view("<u4").ravel(), counts


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def discounts(t: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more from the counts of counts."""
    if min(t) <= 0:
        return DEFAULT_DISCOUNTS
    y = t[0] / (t[0] + 2 * t[1])
    return tuple(min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def discount_of(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts <= 0, 0.0, np.array([0.0, *d])[np.clip(counts, 0, 3)])


def is_held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7; a null id is in training."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7)) == 2, F.lit(False))


class Slots(dict):
    """Words to numbers in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self)
        return slot


class Hashes(dict):
    """Words to their hashes, which are found when they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Words:
    """In a worker: numbers and table values of words, remembered while there is room."""

    def __init__(self, path: str, parts: int, bases: tuple[int, ...], hot: tuple[int, ...], model: Model | None = None):
        self.path, self.parts, self.bases, self.model = path, parts, np.array(bases, np.int64), model
        self.hot_numbers = np.array(hot, np.int64)
        self.files: dict[tuple[str, int], dict[str, np.ndarray]] = {}
        self.clear()

    def clear(self) -> None:
        self.slots = Slots()
        self.number = np.empty(0, np.int64)
        self.hot = np.empty(0, bool)
        self.values: dict[str, np.ndarray] = {}
        self.slots[b"\n"]  # the end token has slot 0
        self.learn()

    def file(self, kind: str, part: int) -> dict[str, np.ndarray]:
        if (kind, part) not in self.files:
            self.files[kind, part] = shared_map(f"{self.path}/{kind}/part-{part:06d}.bin")
        return self.files[kind, part]

    def unmap(self) -> None:
        """Let go of the parts, if they lie in a mounted folder; copies from a store stay for the worker's next task."""
        if mounted(self.path):
            self.files.clear()

    def learn(self) -> None:
        """The numbers and values of the words that have got slots since."""
        words = list(islice(self.slots, len(self.number), None))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        part = hash_part(hashes, self.parts)
        number, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        there = frozenset(np.flatnonzero(np.diff(self.bases)).tolist())
        for p, mine in _in_parts(part, there):
            table = self.file("words", p)
            at = np.minimum(np.searchsorted(table["keys"], hashes[mine]), len(table["keys"]) - 1)
            hit = table["keys"][at] == hashes[mine]
            number[mine[hit]] = self.bases[p] + at[hit]
            counts[mine[hit]] = table["counts"][at[hit]]
        self.number = np.concatenate((self.number, number))
        self.hot = np.concatenate((self.hot, np.isin(number, self.hot_numbers)))
        if self.model:
            found = self._values(number) | {"count": counts}
            self.values = {k: np.concatenate((self.values[k], v)) if self.values else v for k, v in found.items()}

    def _values(self, number: np.ndarray) -> dict[str, np.ndarray]:
        """Of each word: its unigram probability, and as a context its count and what it leaves to the unigrams."""
        m = self.model
        columns = {k: np.zeros(len(number), np.int64) for k in ("total", "n1", "n2", "n3", "continuations")}
        part = np.where(number >= 0, number // m.step, -1)
        for p in np.unique(part[part >= 0]).tolist():
            mine = np.flatnonzero(part == p)
            table = self.file("contexts", p)
            for k, v in columns.items():
                v[mine] = table[k][number[mine] - p * m.step]
        c = columns["continuations"]
        _, d, du = m.discounts
        unigram = np.maximum(c - discount_of(c, du), 0) / max(1, m.pairs) + m.unigram_gamma / (m.vocabulary + 1)
        left = d[0] * columns["n1"] + d[1] * columns["n2"] + d[2] * columns["n3"]
        gamma = np.where(columns["total"] > 0, left / np.maximum(1, columns["total"]), 1.0)
        return {"unigram": unigram, "total": columns["total"], "gamma": gamma}

    def slots_of(self, tokens: list[list[bytes]]) -> np.ndarray:
        """Slots of all tokens of a batch of texts, each text's followed by the end token's."""
        if len(self.slots) > REMEMBERED:
            self.clear()
        out = np.zeros(sum(map(len, tokens)) + len(tokens), np.int64)
        at = 0
        get = self.slots.__getitem__
        for t in tokens:
            out[at : at + len(t)] = np.fromiter(map(get, t), np.int64, len(t))
            at += len(t) + 1
        if len(self.slots) > len(self.number):
            self.learn()
        return out


_WORDS: dict[tuple, Words] = {}


def words_for(path: str, parts: int, bases: tuple[int, ...], hot: tuple[int, ...], model: Model | None = None) -> Words:
    if (path, model is None) not in _WORDS:
        _WORDS.clear()  # those of another model, or of the counting before the scores
        _WORDS[path, model is None] = Words(path, parts, bases, hot, model)
    return _WORDS[path, model is None]


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with about BATCH_BYTES of text, and their tokens."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        for a, b in by_bytes(texts, BATCH_BYTES):
            yield batch.slice(a, b - a), [tokens_of(t) for t in texts[a:b]]


def _word_blocks(train: DataFrame, parts: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _WORDS.clear()  # a worker that scored with another model has no more use for it
        give_back()
        hashes = Hashes()
        held: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            part = hash_part(keys, parts)  # in the order of the keys
            first = _starts(part)
            return _batch(WORD_BLOCK, [(int(part[a]), pack_keys(keys[a:b]), counts[a:b].astype("<u4").tobytes()) for a, b in zip(first, np.append(first[1:], len(part)))])

        for _, tokens in _texts(batches, 0):
            if len(hashes) > REMEMBERED:
                hashes.clear()
            for t in tokens:
                held.append(np.fromiter(map(hashes.__getitem__, t), np.uint64, len(t)))
                size += len(t) + 1
            held.append(np.full(len(tokens), END, np.uint64))
            if size >= BLOCK_TOKENS:
                yield block()
                held, size = [], 0
                give_back()
        if size:
            yield block()
        hashes.clear()
        held.clear()
        give_back()

    return train.mapInArrow(count, WORD_BLOCK)


def before(values: np.ndarray, sizes: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """For each token what stands two and one before it in its text; `end` where the text begins. sizes: tokens of each text."""
    one = np.concatenate((np.full(1, end, values.dtype), values[:-1]))  # a text before it ends with the end token
    two = np.concatenate((np.full(1, end, values.dtype), one[:-1]))
    two[np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)] = end
    return two, one


def pair_keys(first: np.ndarray, second: np.ndarray, vocabulary: int) -> np.ndarray:
    return first.astype(np.uint64) * np.uint64(vocabulary) + second.astype(np.uint64)


def _triple_blocks(train: DataFrame, path: str, parts: int, bases: tuple[int, ...], hot: tuple[int, ...]) -> DataFrame:
    vocabulary = bases[-1]
    width = max(1, -(-vocabulary.bit_length() // 8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_for(path, parts, bases, hot)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def block() -> pa.RecordBatch:
            context, word, is_hot = (np.concatenate(x) for x in zip(*held))
            held.clear()
            hashes = triple_hash(context, word)
            order = np.argsort(hashes)
            first = _starts(hashes[order])
            counts = np.diff(np.append(first, len(order)))
            some = order[first]
            context, word = context[some], word[some]
            part = triple_part(context, hashes[some], is_hot[some], parts)
            order = np.argsort(context)
            order = order[np.argsort(_small(part[order]), kind="stable")]
            part, context, word, counts = part[order], context[order], word[order], counts[order]
            first, rows = _starts(part), []
            for a, b in zip(first, np.append(first[1:], len(part))):
                own = _starts(context[a:b])
                sizes = np.diff(np.append(own, b - a))
                body = word[a:b].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
                rows.append((int(part[a]), pack_keys(context[a:b][own]), sizes.astype("<u4").tobytes(), body.tobytes(), counts[a:b].astype("<u4").tobytes()))
            return _batch(TRIPLE_BLOCK, rows)

        for _, tokens in _texts(batches, 0):
            slots = words.slots_of(tokens)
            two, one = before(slots, np.array([len(t) + 1 for t in tokens]), 0)
            number = words.number
            held.append((pair_keys(number[two], number[one], vocabulary), number[slots].astype(np.uint32), words.hot[two] & words.hot[one]))
            size += len(slots)
            if size >= BLOCK_TRIPLES:
                yield block()
                size = 0
                give_back()
        if size:
            yield block()
        words.clear()
        give_back()

    return train.mapInArrow(count, TRIPLE_BLOCK)


def _spread(blocks: DataFrame, tasks: int) -> DataFrame:
    return blocks.repartition(tasks, "part").sortWithinPartitions("part")


def _pair_rows(kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> list[tuple]:
    """Blocks of pair keys (sorted) for the parts of pairs; counts: a row for each number a key has."""
    part = _by_pieces(lambda k: hash_part(mix(k), parts), np.uint16 if parts < 1 << 16 else np.uint32, keys)
    order = np.argsort(part, kind="stable")
    keys, counts, part = keys[order], counts[:, order], part[order]
    first = _starts(part)
    return [(int(part[a]), kind, pack_keys(keys[a:b]), np.ascontiguousarray(counts[:, a:b]).astype("<u4").tobytes(), [0] * 5) for a, b in zip(first, np.append(first[1:], len(part)))]


def fit(train: DataFrame) -> Model:
    """train: column text, not null. Counts all of it and writes the arrays to the shared folder."""
    spark = train.sparkSession
    prepare(spark)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(tasks, -(-size // PART_BYTES))  # each part of triples sends blocks to each part of pairs: their product is to stay small
    path = fresh_path(spark, "ngram-lm")

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in _by_part(batches):
            keys, counts = _summed(blocks)
            counts = counts[0]
            shared_save(f"{path}/words/part-{part:06d}.bin", keys=keys, counts=counts)
            top = np.argsort(-counts, kind="stable")[:HOTTEST]
            yield _batch(WORD_SUMS, [(part, len(keys), int(counts.sum()), top.tolist(), counts[top].tolist())])

    with shuffles_freed(spark), small_batches(spark, BLOCK_BATCH_BYTES):
        sums = _spread(_word_blocks(train, parts), tasks).mapInArrow(write_words, WORD_SUMS).collect()
    sizes = np.zeros(parts, np.int64)
    for r in sums:
        sizes[r.part] = r.words
    bases = tuple(np.concatenate(([0], np.cumsum(sizes))).tolist())
    vocabulary, tokens = bases[-1], sum(r.tokens for r in sums)
    if vocabulary >= 1 << 32:
        raise OverflowError("pair keys hold word numbers of 32 bits")
    step = max(1, -(-vocabulary // parts))
    hot = tuple(sorted(bases[r.part] + i for r in sums for i, n in zip(r.top, r.top_counts) if 4 * parts * n > tokens))
    width = max(1, -(-vocabulary.bit_length() // 8))

    def write_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _WORDS.clear()  # a worker that counted before has no more use for them
        hot_numbers = np.array(hot, np.int64)
        ends = Words(path, parts, bases, hot).number[0]
        for part, blocks in _by_part(batches):
            context, word, counts = _triples(blocks, width)
            hashes = _by_pieces(triple_hash, np.uint64, context, word)
            order = np.argsort(hashes)
            hashes = hashes[order]
            first = _starts(hashes)
            hashes, counts = hashes[first], np.add.reduceat(counts[order], first, dtype=np.int64)
            order = order[first]
            context, word = context[order], word[order]
            del order, first
            shared_save(f"{path}/triples/part-{part:06d}.bin", **hash_array(hashes), **narrow("counts", counts))
            del hashes
            order = np.argsort(context)
            context, word, counts = context[order], word[order], counts[order]
            del order
            first = _starts(context)
            add = lambda x: np.add.reduceat(x.astype(np.int64), first)
            stats = np.stack([add(counts), add(counts == 1), add(counts == 2), add(counts > 2)])
            own = context[first]
            u, v = (own // np.uint64(vocabulary)).astype(np.int64), (own % np.uint64(vocabulary)).astype(np.int64)
            # a context that is counted once has one word; the pair's own entry says that it is there. Parts of hot ones are all sent.
            some = (stats[0] > 1) | (np.isin(u, hot_numbers) & np.isin(v, hot_numbers)) | ((u == ends) & (v == ends))
            sums = [len(counts), *_counts_of_counts(counts)]
            rows = _pair_rows(1, own[some], stats[:, some], parts)
            sizes = np.diff(np.append(first, len(context)))
            del context, counts, own, u, some, stats
            pairs = pair_keys(np.repeat(v, sizes), word, vocabulary)
            del word, v, first, sizes
            pairs.sort()
            first = _starts(pairs)
            distinct = np.diff(np.append(first, len(pairs))).astype(np.uint32)
            pairs = pairs[first]
            rows += _pair_rows(0, pairs, distinct[None, :], parts)
            del pairs, distinct, first
            rows[-1] = (*rows[-1][:4], sums)
            for a in range(0, len(rows), 64):
                yield _batch(PAIR_BLOCK, rows[a : a + 64])
            yield _batch(PAIR_BLOCK, [(-1 - part, 0, b"", b"", [0] * 5)])  # says that the part is there
            del rows
            give_back()

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in _by_part(batches):
            of_pairs, of_contexts = ([x[1:3] for x in blocks if x[0] == kind] for kind in (0, 1))
            blocks.clear()
            keys, counts = _summed(of_pairs)
            counts = counts[0]
            contexts, stats = _summed(of_contexts, width=4)
            hashes = _by_pieces(mix, np.uint64, contexts)
            order = np.argsort(hashes)
            columns = {f"context_{k}": x for k, x in hash_array(hashes[order]).items()}
            columns |= {k: x for name, row in zip(STATS, stats) for k, x in narrow(name, row[order]).items()}
            del contexts, stats
            hashes = _by_pieces(mix, np.uint64, keys)
            order = np.argsort(hashes)
            shared_save(f"{path}/pairs/part-{part:06d}.bin", **hash_array(hashes[order]), **narrow("counts", counts[order]), **columns)
            del hashes, order, columns
            yield from _number_rows(part, keys, counts, vocabulary, step)
            give_back()

    def write_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in _by_part(batches):
            table = np.zeros((5, step), np.int64)
            for keys, counts, _ in blocks:
                table[:, unpack_keys(keys).astype(np.int64) - part * step] += np.frombuffer(counts, "<u8").reshape(5, -1).astype(np.int64)
            shared_save(f"{path}/contexts/part-{part:06d}.bin", **dict(zip((*STATS, "continuations"), table)))
            c = table[4]
            yield _batch("part long, u1 long, u2 long, u3 long, u4 long, more long", [(part, *_counts_of_counts(c), int((c > 2).sum()))])

    with shuffles_freed(spark), small_batches(spark, BLOCK_BATCH_BYTES):
        triples = _spread(_triple_blocks(train, path, parts, bases, hot), tasks).mapInArrow(write_triples, PAIR_BLOCK)
        triples = written(triples, "pair-sums")
        pairs = _spread(triples.where("part >= 0"), tasks).mapInArrow(write_pairs, NUMBER_BLOCK)
        pairs = written(pairs, "word-sums")
        numbers = _spread(pairs.where("part >= 0"), tasks).mapInArrow(write_numbers, "part long, u1 long, u2 long, u3 long, u4 long, more long").collect()
    total = lambda df: [df.agg(*(F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(5))).first()[k] for k in range(5)]
    there = lambda df: frozenset(-1 - r.part for r in df.where("part < 0").select("part").distinct().collect())
    (_, *t), (n_pairs, *p) = total(triples), total(pairs)
    u = [sum(r[k] for r in numbers) for k in ("u1", "u2", "u3", "u4", "more")]
    du = discounts(u[:4])
    gamma = (du[0] * u[0] + du[1] * u[1] + du[2] * u[4]) / n_pairs if n_pairs else 1.0
    files = {"triples": there(triples), "pairs": there(pairs)}
    return Model(path, parts, vocabulary, tokens, bases, step, n_pairs, (discounts(t), discounts(p), du), gamma, hot, files)


STATS = ("total", "n1", "n2", "n3")
WORD_SUMS = "part long, words long, tokens long, top array<long>, top_counts array<long>"


def _number_rows(part: int, keys: np.ndarray, counts: np.ndarray, vocabulary: int, step: int) -> Iterator[pa.RecordBatch]:
    """What pairs have for each word: as a context the sum and the counts of counts, as a last word the distinct contexts."""
    context = _by_pieces(lambda k: k // np.uint64(vocabulary), np.uint32, keys)
    word = _by_pieces(lambda k: k % np.uint64(vocabulary), np.uint32, keys)
    first = _starts(context)
    numbers = np.union1d(context[first], word).astype(np.int64)
    c = np.repeat(np.searchsorted(numbers, context[first]), np.diff(np.append(first, len(context))))
    w = np.searchsorted(numbers, word)
    del context, word
    add = lambda at: np.bincount(at, minlength=len(numbers)).astype("<u8")
    table = np.stack([np.bincount(c, counts, len(numbers)).astype("<u8"), *(add(x) for x in (c[counts == 1], c[counts == 2], c[counts > 2], w))])
    first = _starts(numbers // step)
    rows = [(int(numbers[a]) // step, pack_keys(numbers[a:b].astype(np.uint64)), np.ascontiguousarray(table[:, a:b]).tobytes(), [0] * 5) for a, b in zip(first, np.append(first[1:], len(numbers)))]
    yield _batch(NUMBER_BLOCK, [*rows, (-1 - part, b"", b"", [len(keys), *_counts_of_counts(counts)])])


def _in_parts(part: np.ndarray, there: frozenset[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each part that was written."""
    order = np.argsort(_small(part), kind="stable")
    first = _starts(part[order])
    for a, b in zip(first, np.append(first[1:], len(part))):
        if int(part[order[a]]) in there:
            yield int(part[order[a]]), order[a:b]


def token_probabilities(words: Words, model: Model, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The model's probability of each token after the two before it; sizes: tokens of each text."""
    two, one = before(slots, sizes, 0)
    number, v, n = words.number, words.values, len(slots)
    d3, d2, _ = model.discounts
    known = [number[x] >= 0 for x in (two, one, slots)]

    # each token's pair with the one before it is the context of the next; a text begins with the pair of two ends, the last here
    own_pair = np.concatenate((pair_keys(number[one], number[slots], model.vocabulary), pair_keys(number[:1], number[:1], model.vocabulary)))
    pair, stats = np.zeros(n + 1, np.int64), np.zeros((4, n + 1), np.int64)
    some = np.append(np.flatnonzero(known[1] & known[2]), n)
    hashes = mix(own_pair[some])
    for part, mine in _in_parts(hash_part(hashes, model.parts), model.there["pairs"]):
        table, at_token = words.file("pairs", part), some[mine]
        at = find(table, hashes[mine])
        hit = np.flatnonzero(at >= 0)
        pair[at_token[hit]] = widen(table, "counts", at[hit])
        stats[:2, at_token[hit]] = 1  # unless it has sums, a pair that is there was a context once
        at = find(table, hashes[mine], "context_")
        hit = np.flatnonzero(at >= 0)
        for k, name in enumerate(STATS):
            stats[k, at_token[hit]] = widen(table, name, at[hit])
    context_of = np.arange(-1, n - 1)
    context_of[np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)] = n
    stats, contexts, pair = stats[:, context_of], own_pair[context_of], pair[:n]

    triple = np.zeros(n, np.int64)
    some = np.flatnonzero((stats[0] > 0) & known[2])
    contexts = contexts[some]
    hashes = triple_hash(contexts, number[slots[some]])
    hot = words.hot[two[some]] & words.hot[one[some]]
    for part, mine in _in_parts(triple_part(contexts, hashes, hot, model.parts), model.there["triples"]):
        table = words.file("triples", part)
        at = find(table, hashes[mine])
        hit = np.flatnonzero(at >= 0)
        triple[some[mine[hit]]] = widen(table, "counts", at[hit])

    lower = np.maximum(pair - discount_of(pair, d2), 0) / np.maximum(1, v["total"][one]) + v["gamma"][one] * v["unigram"][slots]
    total = np.maximum(1, stats[0])
    gamma = np.where(stats[0] > 0, (d3[0] * stats[1] + d3[1] * stats[2] + d3[2] * stats[3]) / total, 1.0)
    return np.maximum(triple - discount_of(triple, d3), 0) / total + gamma * lower


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from the texts that are not held out and scores all. Tokens are words with A-Z in lower case, then one
    end; a null or empty text is its end token. base_score is the add-one unigram model's log10 probability, score this
    trigram model's (two end tokens stand before a text), perplexity is per token. With nothing to learn from, every token is
    unknown and has probability 1. A null id stays null and is learned from; ids that are no longs raise; repeated rows are
    learned from and scored each; other columns are not read. A very long text is counted and scored as one, with about a
    hundred bytes of memory for each of its tokens.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    model = fit(rows.where("NOT held_out").select("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_for(model.path, model.parts, model.bases, model.hot, model)
        for batch, tokens in _texts(batches, 2):
            slots = words.slots_of(tokens)
            n = np.array([len(t) + 1 for t in tokens], np.int64)
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            count = words.values["count"][slots]
            base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
            own = np.log10(token_probabilities(words, model, slots, n))
            total = np.add.reduceat(own, first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                    pa.array(np.full(len(n), model.tokens)), pa.array(np.add.reduceat(base, first)), pa.array(total), pa.array(10 ** (-total / n)),
                ],
                names=[x.split()[0] for x in SCORES.split(", ")],
            )
        words.unmap()
        give_back()

    return rows.mapInArrow(score, SCORES)
