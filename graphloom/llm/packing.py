"""Best-fit packing of token sequences by linear grouping.

There are at most `capacity` different lengths, so the whole plan is made from a histogram of them on the driver, however
many documents there are: large lengths are rounded up within groups of equal cardinality; a linear program over
configurations of the few rounded sizes, solved by column generation, says how many sequences of each configuration there
are; actual pieces take the places of rounded ones, and small pieces go by best fit into what is left. The plan is a list of runs (so many pieces of one length, from one rank on, go into consecutive
sequences at one offset). Pieces get a rank among those of their length, and a join with the runs places them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import coder_for
from graphloom.llm.common import by_bytes, prepare, text_of, unused, written

CAPACITY = 1024
END_ID = 2
#: Groups of the large lengths, and the length from which one is large, as a share of the capacity.
GROUPS = 256
LARGE = 1 / 16
#: Steps of the linear program at most; it stops before when no configuration can improve it.
STEPS = 6000
BATCH_BYTES = 2_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token pieces of each text: doc_id, piece, start, length, ids_crc32. All pieces but the first are full."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in by_bytes(texts, BATCH_BYTES):
                rows: list[tuple[int, int, int, int, int]] = []
                for i, ids in enumerate(coder.encode(texts[a:b]), a):
                    ids += end
                    n = len(ids) // 4
                    marks = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    rows += [(i, k, x, y - x, zlib.crc32(ids[4 * x : 4 * y])) for k, (x, y) in enumerate(zip(marks, marks[1:]))]
                at, *rest = zip(*rows)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, kind) for x, kind in zip(rest, kinds))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(cut, PIECES)


class _Stock:
    """Pieces not placed yet: those of each length are taken from rank 0 on."""

    def __init__(self, counts: dict[int, int]):
        self.left = dict(counts)
        self.taken = dict.fromkeys(counts, 0)

    def take(self, length: int, n: int) -> int:
        first = self.taken[length]
        self.taken[length] += n
        self.left[length] -= n
        return first


def grouped(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths in descending order, in groups that hold about as many pieces each; a length is not divided."""
    total, out, seen = sum(counts.values()), [], 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        k = min(groups - 1, seen * groups // max(1, total))
        if not out or k != out[-1][0]:
            out.append((k, []))
        out[-1][1].append(length)
        seen += counts[length]
    return [x for _, x in out]


def best_configuration(room: int, sizes: np.ndarray, values: np.ndarray) -> tuple[float, np.ndarray]:
    """The most valuable configuration of sizes that fits in room, and its value: a knapsack over all rooms at once."""
    low = int(sizes.min())
    best, last = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    for a in range(low, room + 1, low):  # rooms that are less than a size apart don't depend on each other
        r = np.arange(a, min(a + low, room + 1))
        rest = r[:, None] - sizes[None, :]
        gains = np.where(rest >= 0, best[np.maximum(rest, 0)] + values[None, :], 0.0)
        k = gains.argmax(axis=1)
        own = gains[np.arange(len(r)), k]
        best[r] = np.maximum(np.maximum.accumulate(own), best[a - 1])
        better = own > np.concatenate(([best[a - 1]], best[r[:-1]])) + 1e-12
        last[r] = np.where(better, k, -1)
    out, r = np.zeros(len(sizes), np.int64), room
    while r >= low:
        if last[r] < 0:
            r -= 1
            continue
        out[last[r]] += 1
        r -= int(sizes[last[r]])
    return float(best[room]), out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(how many of each size, sequences) by the linear program of fewest sequences, rounded down.

    The simplex method on configurations; the one that enters is the best knapsack under the current prices of the sizes.
    """
    size, need = np.array(sizes, np.int64), np.array(demand, float)
    n = len(size)
    columns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    for _ in range(STEPS):
        prices = inverse.sum(axis=0)  # every configuration costs one sequence
        value, entering = best_configuration(capacity, size, prices)
        if value <= 1 + 1e-9:
            break
        amounts, direction = inverse @ need, inverse @ entering
        some = np.flatnonzero(direction > 1e-9)
        leaving = int(some[np.argmin(amounts[some] / direction[some])])
        columns[:, leaving] = entering
        inverse[leaving] /= direction[leaving]
        others = np.arange(n) != leaving
        inverse[others] -= np.outer(direction[others], inverse[leaving])
    amounts = np.maximum(0, np.linalg.solve(columns, need))
    return [(columns[:, j].astype(int).tolist(), times) for j in range(n) if (times := int(amounts[j] + 1e-7))]


def fill(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """How many of each size (there are left[i]) add up to the most that fits in room; larger sizes first among equals."""
    best: dict[int, tuple[int, ...]] = {0: ()}
    for i, size in enumerate(sizes):
        for total, chosen in list(best.items()):
            for n in range(1, min(left[i], (room - total) // size) + 1):
                best.setdefault(total + n * size, (*chosen, *([i] * n)))
        if room in best:
            break
    chosen = best[max(best)]
    return [chosen.count(i) for i in range(len(sizes))]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) that place every piece of a histogram of lengths.

    A run puts pieces of ranks first, first + 1, ... into sequences first, first + 1, ..., one each, at the same offset.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    bins: list[list[int]] = []  # [used, first sequence, sequences]
    stock = _Stock(counts)
    new = 0
    big = {x: n for x, n in counts.items() if x >= large * capacity and n}
    members = grouped(big, groups)
    sizes = [x[0] for x in members]  # the rounded size: the largest of its group, groups go down

    def use(config: list[int], times: int) -> None:  # actual pieces take the places of the rounded sizes
        nonlocal new, bins
        open_bins = [[0, new, times]]
        new += times
        for i, n in enumerate(config):
            for _ in range(n):
                open_bins = _place(stock, members[i], open_bins, runs)
        bins += open_bins

    demand = [sum(stock.left[x] for x in g) for g in members]
    for config, times in configurations(sizes, demand, capacity) if sizes else []:
        use(config, times)
    # what rounding down has left, a few sequences for each size: one by one, the largest with what fills it best
    while any(left := [sum(stock.left[x] for x in g) for g in members]):
        first = next(i for i, n in enumerate(left) if n)
        left[first] -= 1
        config = fill(capacity - sizes[first], sizes, left)
        config[first] += 1
        left[first] += 1
        use(config, min(left[i] // n for i, n in enumerate(config) if n))
    for length in sorted((x for x, n in stock.left.items() if n), reverse=True):  # the small ones, by best fit
        while n := stock.left[length]:
            fits = [b for b in bins if b[0] + length <= capacity]
            if not fits:
                per = min(n, capacity // length)
                times = n // per
                at = [0, new, times]
                new += times
                for _ in range(per):
                    runs.append((length, stock.take(length, times), times, at[1], at[0]))
                    at[0] += length
                bins.append(at)
                continue
            best = max(fits, key=lambda b: (b[0], -b[1]))
            k = min(n, best[2])
            runs.append((length, stock.take(length, k), k, best[1], best[0]))
            bins.remove(best)
            bins.append([best[0] + length, best[1], k])
            if k < best[2]:
                bins.append([best[0], best[1] + k, best[2] - k])
    return runs


def _place(stock: _Stock, lengths: list[int], bins: list[list[int]], runs: list) -> list[list[int]]:
    """One piece of a group into each of the sequences; the longest go first."""
    out = []
    for used, first, n in bins:
        while n:
            length = next(x for x in lengths if stock.left[x])
            k = min(n, stock.left[length])
            runs.append((length, stock.take(length, k), k, first, used))
            out.append([used + length, first, k])
            first, n = first + k, n - k
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: gapless from 0 in each sequence, which holds `capacity` tokens at most.

    Needs a column length (1 to capacity). To the driver go the counts of the lengths, and of the lengths in each sorted
    part (parts and lengths together, for a part holds a range of lengths). Equal rows are placed apart; an empty table gives
    an empty result. Columns sequence_id and offset that pieces has (in any case) are replaced; all others stay.
    """
    spark = pieces.sparkSession
    prepare(spark)
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    columns = pieces.columns
    own_part, own_rank = unused(columns, "_part"), unused(columns, "_rank")
    order = [F.col(f"`{c}`") for c in ("length", *(c for c in columns if c != "length"))]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a range of (length, id) per part: pieces of one frequent length go to many parts
    sorted_pieces = written(pieces.repartitionByRange(parts, *order).withColumn(own_part, F.spark_partition_id()), "sorted-pieces")
    numbers = sorted_pieces.groupBy(F.col(own_part).alias("part"), "length").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "part").collect()
    counts: dict[int, int] = {}
    before = []
    for r in numbers:
        before.append((r["part"], r["length"], counts.get(r["length"], 0)))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    if not counts:
        return pieces.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    runs = np.array(sorted(plan(counts, capacity)), np.int64)
    shifts = {(p, length): n for p, length, n in before}
    schema = sorted_pieces.drop(own_part).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column(own_rank).to_numpy() - 1
            part = batch.column(own_part).to_numpy()
            mark = np.flatnonzero(np.concatenate(([True], (length[1:] != length[:-1]) | (part[1:] != part[:-1]))))
            sizes = np.diff(np.append(mark, len(length)))
            rank = rank + np.repeat([shifts[int(part[i]), int(length[i])] for i in mark], sizes)
            # runs are ordered by (length, first rank) and cover all ranks
            at = np.searchsorted(runs[:, 0] * (1 << 40) + runs[:, 1], length * (1 << 40) + rank, side="right") - 1
            kept = [batch.column(c) for c in columns]
            kept += [pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays(kept, names=[*columns, "sequence_id", "offset"])

    within = Window.partitionBy(own_part, "length").orderBy(*order)
    return sorted_pieces.withColumn(own_rank, F.row_number().over(within)).mapInArrow(place, schema)


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text (null: empty) and one end_id. Only documents longer than the capacity are cut; the
    first piece takes what is over. Repeated rows are packed each; null ids stay null, ids that are no longs raise; other
    columns are not read. A very long text is encoded whole by one task and gives a row for each piece.
    """
    return pack(written(pieces_of(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity)
