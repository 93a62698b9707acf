"""How far the sources of a language differ in their words, and the words that set a source apart.

Texts become terms on bytes: a lookup table over the concatenated UTF-8 buffers of many texts tells term bytes from others and
lower-cases A-Z at once, changes in it are the boundaries, slices are grouped by XXH64, and each slice is compared byte by byte
with the first of its group, so that a collision only costs time. Counts are then summed by Spark. A language's terms are dealt
into buckets; a bucket is a CSR matrix (source, term), and sums of divergences between sources are taken over its rows by
reduceat, where terms that neither source has are priced together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import prepare, shuffles_freed, text_of, written

LEAST_DOCS, TOP_TERMS = 10, 10
SCALE = 10**9
#: Bytes of text that are tokenized together; a longer text is cut where no term is.
AT_ONCE = 4 << 20
#: Entries of one bucket's matrix, about, and pairs of sources that one task sums.
BUCKET_ENTRIES, TASK_PAIRS = 30_000, 1_000_000

#: The byte that stands for each byte: 0 for bytes of no term, lower case for A-Z.
TERM_BYTES = np.zeros(256, np.uint8)
TERM_BYTES[0x80:] = np.arange(0x80, 0x100)
TERM_BYTES[0x61:0x7B] = TERM_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms(texts: list[bytes], digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct terms of the texts, and for each occurrence the place of its term and of its text."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    mapped = TERM_BYTES[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    edges = np.flatnonzero(np.diff((mapped != 0).view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]  # the last byte is a separator, so every term has an end
    if not len(starts):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    data = mapped.tobytes()
    hashes = np.array([digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate(([True], np.diff(hashes[order]) != 0))
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    first = order[new]
    differs = _differ(mapped, starts, ends, first[code])
    distinct = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    # a slice that is not the one its group has been named by: such slices are told apart by their bytes
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(differs).tolist():
        term = data[starts[i] : ends[i]]
        if term not in others:
            others[term] = len(distinct)
            distinct.append(term)
        code[i] = others[term]
    return distinct, code, np.searchsorted(np.cumsum(lengths), starts, side="right")


def _differ(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whether each slice differs from the slice number like[i], byte by byte."""
    length = ends - starts
    out = length != length[like]
    check = np.flatnonzero(~out & (like != np.arange(len(like))))
    if len(check):
        n = length[check]
        at = np.concatenate(([0], np.cumsum(n)[:-1]))
        own = np.arange(n.sum(), dtype=np.int64) + np.repeat(starts[check] - at, n)
        equal = data[own] == data[own + np.repeat(starts[like[check]] - starts[check], n)]
        out[check] = ~np.logical_and.reduceat(equal, at)
    return out


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about AT_ONCE bytes, cut before bytes of no term."""
    at = 0
    while len(text) - at > AT_ONCE:
        to = at + AT_ONCE
        while to < len(text) and TERM_BYTES[text[to]]:
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


TERMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text to counts of terms and of the texts that have them."""

    def rows(langs: list[str], sources: list[str], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        group = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources)], np.int64)
        if len(texts) == 1 and len(texts[0]) > AT_ONCE:
            found: dict[bytes, int] = {}
            for piece in _pieces(texts[0]):
                distinct, code, _ = terms([piece])
                for term, n in zip(distinct, np.bincount(code, minlength=len(distinct)).tolist()):
                    found[term] = found.get(term, 0) + n
            distinct, which, n = list(found), np.arange(len(found)), np.fromiter(found.values(), np.int64, len(found))
            of, docs = np.zeros(len(found), np.int64), np.ones(len(found), np.int64)
        else:
            distinct, code, text = terms(texts)
            key, n = np.unique(code * len(groups) + group[text], return_counts=True)
            pair = np.unique(code * len(texts) + text)
            _, docs = np.unique(pair // len(texts) * len(groups) + group[pair % len(texts)], return_counts=True)
            which, of = key // len(groups), key % len(groups)
        names = [pa.array([g[k] for g in groups], pa.string()).take(pa.array(of)) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*names, pa.array(distinct, pa.binary()).cast(pa.string()).take(pa.array(which)), pa.array(n), pa.array(docs)], schema=TERMS)

    held: tuple[list[str], list[str], list[bytes]] = ([], [], [])
    size = 0
    for batch in batches:
        for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            if held[2] and size + len(x[2]) > AT_ONCE:
                yield from rows(*held)
                held, size = ([], [], []), 0
            for column, value in zip(held, x):
                column.append(value)
            size += len(x[2])
    if held[2]:
        yield from rows(*held)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have the term) of whole texts. Nulls are empty."""
    prepare(docs.sparkSession)
    found = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").alias("text"))
    found = found.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * n / of), exactly, for 0 <= n <= of < 9 * 10^15: long division by digits of base 1000."""
    out, rest = np.zeros(np.broadcast(n, of).shape, np.int64), n
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, of)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); below 2^63 for p, q to 10^9 + 1."""
    return (p - q) ** 2 // (p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` has each other source of the language, `term` the terms that a source has more often.

    A language keeps the terms of at least least_docs of its rows. p of a group and a kept term is 1 + floor(10^9 (n + 2) / (N + 2 V)),
    N its occurrences of kept terms and V their number in the language. A pair's value is the sum of floor((p-q)^2/(p+q)) over all
    kept terms; a term's is the same against its language, where p is greater; those of the first `top` ranks are returned. Ranks
    fall by value, then rise by item in bytes.

    Null lang, source and text are empty, and empty ones are names like others. Each row counts, repeated ones too. A language of one
    source has no pairs; without kept terms, pairs have 0. Texts of any length are whole. An empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    with shuffles_freed(spark):
        counts = written(term_counts(docs), "terms")
        of_term = Window.partitionBy("lang", "term")
        kept = counts.select(
            "lang", "source", "term", "n",
            F.sum("docs").over(of_term).alias("docs"),
            (F.row_number().over(of_term.orderBy("source")) == 1).cast("long").alias("once"),
        ).where(F.col("docs") >= least_docs).drop("docs")
        kept = written(kept, "kept-terms")
        groups = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
        own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("once").alias("once"), F.count(F.lit(1)).alias("entries"))
        # at most one row for each group; a language's sources are as many as the result has rows for one of them
        of_lang = Window.partitionBy("lang")
        size = F.count(F.lit(1)).over(of_lang)
        groups = groups.join(own, ["lang", "source"], "left").na.fill(0).select(
            "lang", "source", "total",
            F.sum("once").over(of_lang).alias("kinds"),
            F.ceil(F.greatest(F.sum("entries").over(of_lang), F.lit(1)) / bucket_entries).alias("buckets"),
            F.ceil(size * size / TASK_PAIRS).alias("blocks"),
            (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"),
        )
        groups = written(groups, "groups")
        langs = groups.select("lang", "buckets", "blocks").distinct()
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
        entries = kept.join(langs, "lang").select("*", blocks).select(
            "lang", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), "block", "source", "term", "n",
            *[F.lit(None).cast("long").alias(c) for c in ("total", "kinds", "own_block")],
        )
        every = groups.select("*", blocks).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket")).select(
            "lang", "bucket", "block", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), "total", "kinds",
            F.pmod("place", "blocks").alias("own_block"),
        )

        def compare(key: tuple, rows: pa.Table) -> pa.Table:
            return _compared(key[0].as_py(), key[2].as_py(), rows, top)

        found = entries.unionByName(every).groupBy("lang", "bucket", "block").applyInArrow(compare, "lang string, source string, part string, item string, value long")
        found = written(found, "divergences")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(best)


def _compared(lang: str, block: int, rows: pa.Table, top: int) -> pa.Table:
    """One bucket: partial sums of the block's sources against all others, and the best terms of each."""
    sources = rows.filter(pc.is_null(rows["term"])).sort_by("source")
    entries = rows.filter(pc.is_valid(rows["term"]))
    names, total = sources["source"].combine_chunks(), sources["total"].to_numpy()
    kinds = 2 * int(sources["kinds"][0].as_py())
    coded = entries["term"].combine_chunks().dictionary_encode()
    column, row = coded.indices.to_numpy().astype(np.int64), pc.index_in(entries["source"].combine_chunks(), names).to_numpy().astype(np.int64)
    order = np.lexsort((column, row))
    n, column, row = entries["n"].to_numpy()[order], column[order], row[order]
    row_at = np.searchsorted(row, np.arange(len(names) + 1))
    width, n_terms = np.diff(row_at), len(coded.dictionary)
    mine = np.flatnonzero(sources["own_block"].to_numpy() == block)

    size = np.maximum(total + kinds, 1)  # no kept terms at all: nothing is divided by it
    p = scaled(n + 2, size[row])
    absent = scaled(np.minimum(2, size), size)
    from_source, from_item, values, step = [], [], [], max(1, 2_000_000 // len(names))
    for g in mine.tolist():
        has = slice(row_at[g], row_at[g + 1])
        dense = np.full(n_terms, absent[g])
        dense[column[has]] = p[has]
        # every source as if it had no term of the bucket, then the difference that its entries make
        sums = (n_terms - width[g]) * divergence(absent, absent[g])
        for a in range(row_at[g], row_at[g + 1], step):
            sums += divergence(absent[:, None], p[a : min(a + step, row_at[g + 1])]).sum(axis=1)
        change = divergence(p, dense[column]) - divergence(absent[row], dense[column])
        filled = np.flatnonzero(width)
        if len(filled):
            sums[filled] += np.add.reduceat(change, row_at[filled])
        others = np.flatnonzero(np.arange(len(names)) != g)
        from_source.append(np.full(len(others), g))
        from_item.append(others)
        values.append(sums[others])
    out = [_rows(lang, "pair", names, np.concatenate([*from_source, []]), names.take(pa.array(np.concatenate([*from_item, []]).astype(np.int64))), np.concatenate([*values, []]))]

    in_lang = np.zeros(n_terms, np.int64)
    np.add.at(in_lang, column, n)
    q = scaled(in_lang + 2, np.full(n_terms, max(1, int(total.sum()) + kinds)))[column]
    value = np.where(p > q, divergence(p, q), -1)
    spelled = coded.dictionary.cast(pa.binary())
    for g in mine.tolist():
        has = np.arange(row_at[g], row_at[g + 1])
        has = has[value[has] >= 0]
        if len(has) > top:
            has = has[value[has] >= np.partition(value[has], len(has) - top)[len(has) - top]]
        term = spelled.take(pa.array(column[has])).to_pylist()
        best = sorted(range(len(has)), key=lambda i: (-value[has[i]], term[i]))[:top]
        out.append(_rows(lang, "term", names, np.full(len(best), g), pa.array([term[i].decode() for i in best], pa.string()), value[has[best]]))
    return pa.concat_tables(out)


def _rows(lang: str, part: str, names: pa.Array, source: np.ndarray, items: pa.Array, values: np.ndarray) -> pa.Table:
    source = names.take(pa.array(source.astype(np.int64)))
    same = lambda x: pa.array([x] * len(source), pa.string())
    return pa.table({"lang": same(lang), "source": source, "part": same(part), "item": items, "value": pa.array(values.astype(np.int64))})
