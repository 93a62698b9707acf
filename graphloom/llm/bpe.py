"""Byte-level BPE through a minimal acyclic transducer.

Frequent words with their ids are compiled into an automaton that shares suffixes; workers memory-map it and look up all
words of a batch at once. Words it does not hold are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, map_shipped, prepare, ship_arrays, text_of, written

#: Frequent words that the automaton holds.
LEXICON_WORDS = 65_536
#: Longer words are merged, not looked up.
LONGEST_WORD = 48
BATCH_BYTES = 2_000_000
REMEMBERED = 1_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: The pre-tokenizer's pattern, a fixed value of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character of a byte-level vocabulary to its byte: printable Latin-1 stands for itself, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Exact ids of a byte_level BPE file, and the bytes of its ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        first = 256
        for i, (a, b) in enumerate(spec["model"]["merges"]):
            if spec["model"]["vocab"][a + b] != first + i:
                raise ValueError(f"{path}: ids do not follow the order of merges, so ranks cannot stand for merges")
        self.special = special
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        for text, i in special.items():
            self.bytes[i] = text.encode()
        self.ranks = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens in it give their ids."""
        if not self.cut or not self.cut.search(text):
            return self.ranks.encode_ordinary(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.ranks.encode_ordinary(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.ranks.encode_ordinary(text[at:])

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of the words as arrays, and their ids.

    Words go in by order; states behind the last word's branching point are final and are merged with an equal one. The
    outputs on a word's arcs add up to its number in the order, under which `starts` and `ids` hold its ids.
    """
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []  # (is a word's end, ((label, target), ...))
    path: list[list] = [[False, []]]  # the last word's states, still open
    last = b""

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            end, arcs = path.pop()
            key = (end, tuple(arcs))
            state = register.get(key)
            if state is None:
                state = register[key] = len(frozen)
                frozen.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], state)

    order = sorted(words)
    for word in order:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        freeze(same)
        for b in word[same:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    frozen.append((path[0][0], tuple(path[0][1])))
    below = np.zeros(len(frozen), np.int64)  # words that end at or behind a state
    keys, targets, outputs = [], [], []
    for state, (end, arcs) in enumerate(frozen):  # targets come before their sources
        n = int(end)
        for label, target in arcs:
            keys.append(state * 256 + label)
            targets.append(target)
            outputs.append(n)
            n += int(below[target])
        below[state] = n
    ids = [words[w] for w in order]
    return {
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int32),
        "outputs": np.array(outputs, np.int32),
        "ends": np.array([end for end, _ in frozen], np.bool_),
        "starts": np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64),
        "ids": np.array([i for x in ids for i in x], np.uint32),
    }


def look_up(lexicon: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The number of each word in the lexicon's order, -1 if it has none; all words move along their arcs together."""
    keys, n = lexicon["keys"], len(words)
    if not len(keys) or not n:
        return np.full(n, -1, np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    state = np.full(n, len(lexicon["ends"]) - 1, np.int64)
    number = np.zeros(n, np.int64)
    alive = np.arange(n)[sizes <= LONGEST_WORD]
    number[sizes > LONGEST_WORD] = -1
    step = 0
    while True:
        done = alive[sizes[alive] == step]
        number[done[~lexicon["ends"][state[done]]]] = -1
        alive = alive[sizes[alive] > step]
        if not len(alive):
            return number
        want = state[alive] * 256 + flat[starts[alive] + step]
        arc = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[arc] == want
        number[alive[~hit]] = -1
        alive, arc = alive[hit], arc[hit]
        state[alive] = lexicon["targets"][arc]
        number[alive] += lexicon["outputs"][arc]
        step += 1


#: A space at an end of the text or beside other white space.
_ODD = re.compile(r"\A | \Z| (?=\s)|(?<=\s) ")


class _Known(dict):
    """Ids of words by the word; a word that is not there is merged, and kept if it is short."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        found = array("I", self.merge(" " + word)).tobytes()
        if len(word) <= 2 * LONGEST_WORD:
            self[word] = found
        return found


class Coder:
    """Encodes texts by words. A word here is what stands between clean spaces, with the space before it.

    A space between two characters that are no white space always starts a pre-token, so such words are encoded one by one.
    Where a space stands beside other white space, the text is not cut; the words around it make one longer word.
    """

    def __init__(self, path: str, lexicon: dict[str, np.ndarray] | None = None):
        self.merger = Merger(path)
        self.lexicon = lexicon
        self.known = _Known(self.merger.ids)
        self.cuts = not any(" " in s for s in self.merger.special)

    def learn(self, texts: list[list[str]]) -> None:
        """Look up the words that are new in the lexicon, all together."""
        new = list(set().union(*texts).difference(self.known))
        number = look_up(self.lexicon, [w.encode() for w in new])
        starts, ids = self.lexicon["starts"], self.lexicon["ids"]
        for i in np.flatnonzero(number >= 0).tolist():
            k = number[i]
            self.known[new[i]] = ids[starts[k] : starts[k + 1]].tobytes()

    def words(self, text: str) -> list[str]:
        """The words; all but the first stand behind a space."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if not _ODD.search(text):
            return parts
        out, held = [], [parts[0]]
        for before, word in zip(parts, parts[1:]):
            if before and word and not before[-1].isspace() and not word[0].isspace():
                out.append(" ".join(held))
                held = []
            held.append(word)
        return [*out, " ".join(held)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = [self.words(t) for t in texts]
        if self.lexicon is not None:
            self.learn([w[1:] for w in words])
        return [b"".join([self.bytes_of(w[0]), *map(self.known.__getitem__, w[1:])]) for w in words]

    def bytes_of(self, text: str) -> bytes:
        return array("I", self.merger.ids(text)).tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.merger.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[tuple[str, str | None], Coder] = {}


def coder_for(path: str, lexicon: str | None = None) -> Coder:
    """In a worker: one coder per process and lexicon."""
    if (path, lexicon) not in _CODERS:
        _CODERS[path, lexicon] = Coder(path, lexicon and map_shipped(lexicon))
    return _CODERS[path, lexicon]


def frequent_words(docs: DataFrame, text_col: str = "text", top: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts that occur twice or more; at most `top` of them reach the driver.

    Counts are binned first (a few hundred bins at most), and whole bins are taken from the top as long as they fit: sorting
    for the exact top would send every task's own top to the driver.
    """
    words = docs.select(F.explode(F.split(text_of(text_col), " ")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 AND word != '' AND octet_length(word) < {LONGEST_WORD}")
    counts = written(counts.withColumn("bin", F.floor(8 * F.log2("n")).cast("int")), "word-counts")
    room, least = top, None
    for r in counts.groupBy("bin").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("bin")).collect():
        room -= r.words
        if room < 0:
            break
        least = r.bin
    return [] if least is None else [r.word for r in counts.where(F.col("bin") >= least).select("word").collect()]


def build_lexicon(words: list[str], path: str) -> dict[str, np.ndarray]:
    """The automaton of words that are safe to encode by themselves."""
    merger = Merger(path)
    fit = {w for w in words if w and not (w[0].isspace() or w[-1].isspace() or merger.has_special(w))}
    return compile_lexicon({w.encode(): merger.ids(" " + w) for w in fit})


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", top: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids: ids (array) and decoded too.

    Ids are those of the tokenizers library with the file at `path` without added special tokens; ids_sha256 is over
    little-endian unsigned 32-bit ids, decoded_sha256 over the decoded text. A null text is empty and has no ids. Repeated
    rows are coded each; a null id stays null, ids that are no longs raise; other columns are not read. A very long text is
    coded by its words; one without clean spaces is merged as a whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    name = ship_arrays(spark, "lexicon", **build_lexicon(frequent_words(docs, text_col, top), path))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(path, name)
        for batch in batches:
            texts, every = batch.column(1).to_pylist(), batch.column(0)
            for a, b in by_bytes(texts, BATCH_BYTES):
                ids = coder.encode(texts[a:b])
                back = [coder.decode(x) for x in ids]
                columns = [
                    every.slice(a, b - a),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([x.decode("utf-8", "replace") for x in back], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = SCHEMA + ", ids array<long>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(code, schema)
