"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are cut at boundaries no token can cross, batches hold about as many bytes each, and each batch encodes a cut-out
string once however often it occurs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, prepare, text_of

#: Bytes of text counted at a time, and of distinct strings in one call of the library.
BATCH_BYTES = 2_000_000
CALL_BYTES = 200_000
#: Strings whose lengths a worker remembers; it forgets all when it has more.
REMEMBERED = 400_000
#: Characters from which a text for a tokenizers file is cut.
LONG = 100_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: Parts of a text: spaces and what follows them. Spaces at the end stay with the last part, for nothing follows them.
_CLEAN_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SPACES = re.compile(r" *[^ ]+(?: +\Z)?| +")


class PieceCounter:
    """Lengths under a sentencepiece model whose pieces have spaces in front only, if at all.

    A space after another character then starts a new piece, so the text between such spaces can be encoded by itself. The
    library puts one space before each text it encodes; that space stands for the one the text was cut at.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "a  b\t  c"
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode(probe, out_type=str) == [
            x for part in ("a", " b\t ", "c") for x in self.model.encode(part, out_type=str)
        ]
        self.lengths: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """Parts whose lengths add up to the text's; each stands after the space it was cut at."""
        text = text.replace("▁", " ")  # the library's own sign for a space
        if not self.cuts or not text:
            return [text]
        if "  " not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        first, *rest = _SPACES.findall(text)
        return [first, *(x[1:] for x in rest)]

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.split(t) for t in texts]
        new = list(set().union(*parts).difference(self.lengths)) if parts else []
        if len(self.lengths) + len(new) > REMEMBERED:
            self.lengths.clear()
            new = list(set().union(*parts))
        for a, b in by_bytes(new, CALL_BYTES):
            self.lengths.update(zip(new[a:b], map(len, self.model.encode(new[a:b], num_threads=1))))
        known = self.lengths.__getitem__
        return [sum(map(known, p)) for p in parts]


class JsonCounter:
    """Lengths under a tokenizers file. A text of more than LONG characters is cut, if the file's own parts allow it.

    They do where nothing rewrites the text and a byte-level pre-tokenizer with its usual pattern starts a part at each space
    between two characters that are no white space. Other files get their texts whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        spec = json.loads(self.model.to_str())
        kind = spec.get("pre_tokenizer") or {}
        byte_level = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        self.cuts = bool(byte_level and not spec.get("normalizer") and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec["added_tokens"]))

    def split(self, text: str) -> list[str]:
        if not self.cuts or len(text) <= LONG:
            return [text]
        out, at = [], 0
        while len(text) - at > LONG:
            cut = _CLEAN_SPACE.search(text, at + LONG // 2)
            if not cut:
                break
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.split(t) for t in texts]
        every = [x for p in parts for x in p]
        sizes: list[int] = []
        for a, b in by_bytes(every, CALL_BYTES):
            sizes += [len(e.ids) for e in self.model.encode_batch(every[a:b], add_special_tokens=False)]
        ends = np.cumsum([len(p) for p in parts]) if parts else []
        sums = np.concatenate(([0], np.cumsum(sizes)))
        return (sums[ends] - sums[np.concatenate(([0], ends[:-1])).astype(int)]).tolist() if parts else []


_COUNTERS: dict[str, PieceCounter | JsonCounter] = {}


def counter_for(path: str) -> PieceCounter | JsonCounter:
    """In a worker: one counter per process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = (PieceCounter if path.endswith(".model") else JsonCounter)(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: a sentencepiece .model or a tokenizers .json, there on every machine. A null or empty text has no bytes and the
    tokens the library gives for "". Repeated rows are counted each; a null id stays null, ids that are no longs raise; other
    columns are not read. Very long texts are cut at spaces where that is safe; one without such spaces goes in whole.
    """
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = pa.compute.binary_length(batch.column(1))
            tokens = [n for a, b in by_bytes(texts, BATCH_BYTES) for n in counter.count(texts[a:b])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes.cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(count, SCHEMA)
