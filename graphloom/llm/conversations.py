"""Repair of a conversation's structure by a DP over the turns that stay.

Some turns stay as they are or with another role, the rest go; blank and repeated turns have to. A turn that stays follows the
nearest better one before it: the turns between are priced by prefix sums of deletions, so that for each role of the last turn
that stayed one running minimum is enough, and the pair of roles says what has to be inserted between. Of equally cheap repairs
the one with the ASCII-least audit is taken; audits of one row end in a row's own letter, so none is the beginning of another
and what follows can't change their order.

A conversation of any length is divided: rows are dealt by range and cut into blocks; a block finds the cheapest way from each
role that may precede it to each that it may end with, and the blocks of a conversation are then chained by those few ways.
Texts of a long conversation meet only in the hash that is asked for, block after block.
"""

from __future__ import annotations

import array
import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from graphloom.llm.common import prepare, shuffles_freed, written

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Rows and characters of a block at most (one longer text stands alone).
BLOCK_ROWS, BLOCK_CHARS = 512, 4 << 20
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: What is inserted between the roles of two turns that stay: "" is the start, "." the end.
BETWEEN = {
    ("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a",
    ("a", "u"): "", ("a", "a"): "u", ("", "."): "", ("s", "."): "ua", ("u", "."): "a", ("a", "."): "",
}
BEFORE = ("", "s", "u", "a")
BLANK = r"[^\x20\x09-\x0D]"
_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "longs": pa.list_(pa.int64()), "booleans": pa.list_(pa.bool_()), "strings": pa.list_(pa.string()),
    "ways": pa.list_(pa.struct([("before", pa.string()), ("after", pa.string()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])),
}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


NUMBERS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
BLOCK_SCHEMA = _schema(
    "conv_id long, part int, block long, whole boolean, rows long, last_turn long, least_turn long, turns long, first_role string, last_role string, "
    "blank long, duplicate long, truncated long, illegal long, gone long, ways ways, roles strings, texts strings, copies longs, stays booleans"
)
RESULT_SCHEMA = _schema(f"conv_id long, {NUMBERS}, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after the damage of the contract; nulls of role and text are one space.

    A dropped row stays with no copies and no text, so that its conversation is known. crc32(conv_id:turn) % 20 decides: 0 drops,
    1 empties the text, 2 removes its . ! ?, 3 repeats the row, 4 makes the role user.
    """
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 2, F.regexp_replace(one_space("text"), "[.!?]", "")).when(F.col("kind").isin(0, 1), "").otherwise(one_space("text"))
    return turns.select("conv_id", "turn", "role", "text", kind.alias("kind")).select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(one_space("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns: conv_id, turn, role, text, copies (equal rows in a row; 0: the conversation is known by it and nothing else).
    Rows are taken by turn, nulls first; ties by role, then by the SHA-256 of the text. A null id is an id of its own. A role
    whose initial is none of s, u, a (an empty one too) never stays as it is. Texts of any length are whole; an empty table
    gives an empty result; other columns are not read.
    """
    prepare(turns.sparkSession)
    with shuffles_freed(turns.sparkSession):
        blocks = _block_table(turns, block_rows)
        ways = written(_chosen(blocks.where("NOT whole")), "turn-ways")
    pieces = _mapped(_with_ways(blocks, ways), _piece_lines, PIECE_SCHEMA)
    # a hash has one order: a long conversation's repaired text is read in one task, piece after piece
    chained = _mapped(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block"), _hashed, RESULT_SCHEMA)
    return _mapped(blocks.where("whole"), _finished, RESULT_SCHEMA).unionByName(chained)


def repaired_turns(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The turns of the repaired conversations: conv_id, part, block, place, role, text, inserted; turns and odd input as in repair().

    (part, block, place) is the order of a conversation's turns; a long conversation has several blocks.
    """
    prepare(turns.sparkSession)
    blocks = _block_table(turns, block_rows)
    ways = written(_chosen(blocks), "turn-ways")
    return _mapped(_with_ways(blocks, ways), _turns_of, TURN_SCHEMA)


def _block_table(turns: DataFrame, block_rows: int) -> DataFrame:
    """The blocks of all conversations, written: counts, ways, and the rows that may stay."""
    rows = written(_ordered(turns), "turns")
    keys = ["conv_id", "turn", "role", "digest"]
    # the first of equal turns, as a row without text that comes just before it: this needs no join, so no key is hot
    least = rows.where("copies > 0 AND NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(_nulls_first("turn")).alias("at"))
    none = {"text": F.lit(""), "copies": F.lit(0).cast("long"), "blank": F.lit(False), "truncated": F.lit(False), "first": F.lit(True)}
    marks = least.select("conv_id", F.col("at.turn").alias("turn"), "role", "digest", *[c.alias(k) for k, c in none.items()])
    dealt = rows.withColumn("first", F.lit(False)).unionByName(marks).repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("first").desc())
    return written(_mapped(dealt.select(*keys, *none), partial(_blocks, block_rows=block_rows), BLOCK_SCHEMA), "turn-blocks")


def _nulls_first(column: str) -> Column:
    return F.struct(F.col(column).isNotNull().alias("known"), F.col(column))


def _ordered(turns: DataFrame) -> DataFrame:
    """Equal rows as one with their number, so a row repeated any number of times is one; with the digest and faults of a text."""
    same = turns.select("conv_id", "turn", "role", "text", "copies").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    last = F.regexp_extract(F.col("text"), r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return same.select(
        "conv_id", "turn", "role", "text", "copies",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (~F.col("text").rlike(BLANK)).alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"),
    )


def cheapest(before: Iterable[str], rows: Iterable[tuple[str, bool, bool, int]]) -> tuple[dict[tuple[str, str], tuple[int, str]], int]:
    """The cheapest way from each role in `before` over the rows to each last role: {(before, after): (cost, audit)}, deletions.

    A row is (role, stays, truncated, copies): stays tells whether its first copy may stay; the others have to go. A cost is
    relative to the deletion of all rows, whose cost is returned beside. "" means that no turn has stayed yet.
    """
    least = {(x, x): (0, "") for x in before}  # the running minimum for each last role that stayed: cost less prefix sum, audit
    gone = 0  # the prefix sum of deletions
    for role, stays, truncated, copies in rows:
        if stays:
            own, late = role[:1], TRUNCATED if truncated else 0
            found: dict[tuple[str, str], tuple[int, str]] = {}
            for (start, last), (cost, audit) in least.items():
                for after in "sua":
                    inserted = BETWEEN.get((last, after))
                    if inserted is None or after == "s" != own:
                        continue
                    price = cost + gone + late + INSERT * len(inserted) + (0 if after == own else REROLE) - (gone + DELETE)
                    way = (price, audit + "I" * len(inserted) + ("K" if after == own else "R"))
                    if (start, after) not in found or way < found[start, after]:
                        found[start, after] = way
            gone += DELETE
            least = {k: (cost, audit + "D") for k, (cost, audit) in least.items()}
            for k, way in found.items():
                if k not in least or way < least[k]:
                    least[k] = way
            copies -= 1
        if copies:
            gone += DELETE * copies
            least = {k: (cost, audit + "D" * copies) for k, (cost, audit) in least.items()}
    return least, gone


def ended(ways: Iterable[tuple[str, int, str]]) -> tuple[int, str, str]:
    """Of (last role, cost, audit) the cheapest with what has to be inserted at the end: cost, audit, last role."""
    return min((cost + INSERT * len(BETWEEN[last, "."]), audit + "I" * len(BETWEEN[last, "."]), last) for last, cost, audit in ways)


def edited(before: str, audit: str, rows: Iterable[tuple[str, str, bool, int]]) -> Iterator[tuple[str, str, bool]]:
    """The turns that an audit makes of rows (role, text, stays, copies): role, text, whether it was inserted."""
    last, at, n = before, 0, len(audit)
    follows = lambda: "a" if last == "u" else "u"

    def inserted() -> Iterator[tuple[str, str, bool]]:
        nonlocal last, at
        while at < n and audit[at] == "I":
            last = follows()
            at += 1
            yield ROLES[last], "", True

    for role, text, stays, copies in rows:
        if not copies:
            continue
        if stays:
            yield from inserted()
            if audit[at] == "K":
                last = role[:1]
                yield role, text, False
            elif audit[at] == "R":
                last = follows()
                yield ROLES[last], text, False
        at += copies
    yield from inserted()


def _lines(turns: Iterable[tuple[str, str, bool]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text, _ in turns).encode("utf-8", "surrogatepass")


def _illegal(a: str, b: str) -> bool:
    return a[:1] + b[:1] not in ("su", "ua", "au")


class _Block:
    """Consecutive rows of one conversation."""

    def __init__(self, conv, part: int, block: int):
        self.conv, self.part, self.block = conv, part, block
        self.rows: list[tuple[str, str, bool, bool, int]] = []  # role, text, stays, truncated, copies
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.n = 0
        self.last_turn = self.least_turn = self.first_role = self.last_role = None

    def add(self, turn, role: str, text: str, copies: int, blank: bool, truncated: bool, first: bool) -> None:
        if not copies:
            return
        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            self.turns += 1
        if not self.n:
            self.first_role = role
        elif _illegal(self.last_role, role):
            self.illegal += 1
        self.illegal += copies - 1  # a copy follows its like
        self.least_turn = turn if self.least_turn is None else self.least_turn
        self.last_turn, self.last_role = turn, role
        if blank:
            self.blank += copies
        elif first:
            self.duplicate += copies - 1
            self.truncated += truncated
        else:
            self.duplicate += copies
        self.n += copies
        stays = first and not blank
        self.rows.append((role, text if stays else "", stays, truncated, copies))
        self.chars += len(text) if stays else 0

    def full(self, block_rows: int) -> bool:
        return len(self.rows) >= block_rows or self.chars >= BLOCK_CHARS

    def row(self, whole: bool, starts: bool) -> dict:
        ways, gone = cheapest([""] if starts else BEFORE, ((r, s, t, c) for r, _, s, t, c in self.rows))
        # places of audits among each other: ways are chained by these, without the audits
        order = {audit: k for k, audit in enumerate(sorted({audit for _, audit in ways.values()}))}
        return {
            "conv_id": self.conv, "part": self.part, "block": self.block, "whole": whole, "rows": self.n,
            "last_turn": self.last_turn, "least_turn": self.least_turn, "turns": self.turns, "first_role": self.first_role, "last_role": self.last_role,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "gone": gone,
            "ways": [{"before": a, "after": b, "cost": cost, "rank": order[audit], "audit": audit} for (a, b), (cost, audit) in ways.items()],
            "roles": [r[0] for r in self.rows], "texts": [r[1] for r in self.rows], "copies": [r[4] for r in self.rows], "stays": [r[2] for r in self.rows],
        }


def _mapped(df: DataFrame, make, schema: pa.Schema) -> DataFrame:
    return df.mapInArrow(make, from_arrow_schema(schema))


def _batches(rows: Iterable[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded rows and characters; each row comes with its size."""
    held, size = [], 0
    for row, chars in rows:
        held.append(row)
        size += chars
        if len(held) >= 1024 or size >= BLOCK_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks. A conversation that neither a boundary nor a full block cuts is whole."""
    part = TaskContext.get().partitionId()

    def made() -> Iterator[tuple[dict, int]]:
        here, blocks, since, mark = None, 0, 0, None
        # here: the open block; since: how many its conversation has before it; begins: whether the conversation begins in this part
        begins = False
        for conv, turn, role, digest, text, copies, blank, truncated, first in _records(batches):
            if here is None or conv != here.conv:
                if here is not None:
                    yield here.row(begins and not since, begins and not since), here.chars
                    begins, blocks = True, blocks + 1
                here, since = _Block(conv, part, blocks), 0
            elif here.full(block_rows):
                yield here.row(False, begins and not since), here.chars
                blocks, since = blocks + 1, since + 1
                here = _Block(conv, part, blocks)
            if first:
                mark = (turn, role, digest)
                continue
            here.add(turn, role, text, copies, blank, truncated, mark == (turn, role, digest))
            mark = None
        if here is not None:
            yield here.row(False, begins and not since), here.chars

    return _batches(made(), BLOCK_SCHEMA)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of each conversation that is one block."""

    def made() -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for x in batch.to_pylist():
                cost, audit, _ = ended((w["after"], w["cost"], w["audit"]) for w in x["ways"])
                lines = _lines(edited("", audit, zip(x["roles"], x["texts"], x["stays"], x["copies"])))
                gaps = x["last_turn"] - x["least_turn"] + 1 - x["turns"] if x["turns"] else 0
                yield {
                    **{k: x[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal")},
                    "gaps": gaps, "cost": cost + x["gone"], "audit": audit, "repaired_sha256": hashlib.sha256(lines).hexdigest(),
                }, len(audit)

    return _batches(made(), RESULT_SCHEMA)


WAY_SCHEMA = _schema(f"way_conv long, way_part int, way_block long, before string, after string, tail string, last boolean, {NUMBERS}")
PIECE_SCHEMA = _schema(f"conv_id long, part int, block long, lines binary, some boolean, audit string, last boolean, {NUMBERS}")
TURN_SCHEMA = _schema("conv_id long, part int, block long, place long, role string, text string, inserted boolean")


class _Chain:
    """The blocks of one conversation in their order; what is kept of each is its place and which way leads to each last role."""

    def __init__(self, conv):
        self.conv = conv
        self.total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "gone", "turns"), 0)
        self.least = self.greatest = self.last_role = None
        self.at = {"": (0, 0)}  # cost and rank of the audit so far, by the last role
        self.places, self.back = array.array("q"), bytearray()

    def add(self, b: dict) -> None:
        for k in self.total:
            self.total[k] += b[k]
        if b["rows"]:
            self.total["illegal"] += self.last_role is not None and _illegal(self.last_role, b["first_role"])
            self.last_role = b["last_role"]
        if b["turns"]:
            self.total["turns"] -= self.greatest is not None and b["least_turn"] == self.greatest
            self.least = b["least_turn"] if self.least is None else self.least
            self.greatest = b["last_turn"]
        found: dict[str, tuple] = {}
        for w in b["ways"]:
            if w["before"] in self.at:
                cost, rank = self.at[w["before"]]
                way = (cost + w["cost"], (rank, w["rank"]), BEFORE.index(w["before"]))
                if w["after"] not in found or way < found[w["after"]]:
                    found[w["after"]] = way
        ranks = {x: k for k, x in enumerate(sorted({x[1] for x in found.values()}))}
        self.at = {after: (x[0], ranks[x[1]]) for after, x in found.items()}
        self.places.extend((b["part"], b["block"]))
        self.back.extend(found[x][2] if x in found else 255 for x in BEFORE)

    def ways(self) -> Iterator[tuple[dict, int]]:
        """The way through each block, from the last one back; the last one has the conversation's numbers."""
        tails = {x: "I" * len(BETWEEN[x, "."]) for x in self.at}
        cost, _, tail, after = min((c + INSERT * len(tails[x]), rank, tails[x], x) for x, (c, rank) in self.at.items())
        t = self.total
        gaps = 0 if self.least is None else self.greatest - self.least + 1 - t["turns"]
        numbers = {**{k: t[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "gaps": gaps, "cost": cost + t["gone"]}
        for k in range(len(self.places) // 2 - 1, -1, -1):
            before = BEFORE[self.back[4 * k + BEFORE.index(after)]]
            last = 2 * k + 2 == len(self.places)
            yield {
                "way_conv": self.conv, "way_part": self.places[2 * k], "way_block": self.places[2 * k + 1], "before": before, "after": after,
                "tail": tail if last else "", "last": last, **numbers,
            }, 100
            after = before


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of conversations, in order, to the way through each."""

    def made() -> Iterator[tuple[dict, int]]:
        chain = None
        for batch in batches:
            for x in batch.to_pylist():
                if chain is None or chain.conv != x["conv_id"]:
                    if chain is not None:
                        yield from chain.ways()
                    chain = _Chain(x["conv_id"])
                chain.add(x)
        if chain is not None:
            yield from chain.ways()

    return _batches(made(), WAY_SCHEMA)


def _chosen(blocks: DataFrame) -> DataFrame:
    """The way through each block. No text and no audit is needed for it: a block is some 100 numbers."""
    slim = F.transform("ways", lambda w: F.struct(w["before"].alias("before"), w["after"].alias("after"), w["cost"].alias("cost"), w["rank"].alias("rank")))
    numbers = [c for c in blocks.columns if c not in ("roles", "texts", "copies", "stays", "whole", "ways")]
    dealt = blocks.select(*numbers, slim.alias("ways")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return _mapped(dealt, _ways, WAY_SCHEMA)


def _with_ways(blocks: DataFrame, ways: DataFrame) -> DataFrame:
    """Blocks with the way through them: before, and audit with what the conversation's end inserts."""
    on = [F.col("conv_id").eqNullSafe(F.col("way_conv")), F.col("part") == F.col("way_part"), F.col("block") == F.col("way_block")]
    kept = blocks.select("conv_id", "part", "block", "roles", "texts", "copies", "stays", "ways")
    audit = F.get(F.filter("ways", lambda w: (w["before"] == F.col("before")) & (w["after"] == F.col("after"))), F.lit(0))["audit"]
    numbers = ("last", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return kept.join(ways, on).select("conv_id", "part", "block", "roles", "texts", "copies", "stays", "before", F.concat(audit, "tail").alias("audit"), *numbers)


def _piece_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for x in batch.to_pylist():
                turns = list(edited(x["before"], x["audit"], zip(x["roles"], x["texts"], x["stays"], x["copies"])))
                lines = _lines(turns)
                kept = {k: x[k] for k in ("conv_id", "part", "block", "audit", "last", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
                yield {**kept, "lines": lines, "some": bool(turns)}, len(lines)

    return _batches(made(), PIECE_SCHEMA)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[tuple[dict, int]]:
        digest, audits, some = hashlib.sha256(), [], False
        for batch in batches:
            for x in batch.to_pylist():
                if x["some"]:
                    digest.update(b"\n" * some + x["lines"])
                    some = True
                audits.append(x["audit"])
                if x["last"]:
                    numbers = {k: x[k] for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
                    yield {**numbers, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}, sum(map(len, audits))
                    digest, audits, some = hashlib.sha256(), [], False

    return _batches(made(), RESULT_SCHEMA)


def _turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for x in batch.to_pylist():
                for place, (role, text, new) in enumerate(edited(x["before"], x["audit"], zip(x["roles"], x["texts"], x["stays"], x["copies"]))):
                    yield {**{k: x[k] for k in ("conv_id", "part", "block")}, "place": place, "role": role, "text": text, "inserted": new}, len(text)

    return _batches(made(), TURN_SCHEMA)
