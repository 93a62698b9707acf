"""Conversation repair against brute force over odd conversations, in blocks of every size."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from graphloom.llm import conversations

NAMES = {"s": "system", "u": "user", "a": "assistant"}
COLUMNS = "conv_id long, turn long, role string, text string, kind string, copies string, first string"


def damaged(rows):
    """(conv_id, turn, role, text) after damage, in order, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        mine = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def edit_by_edit(rows, bad):
    """Cheapest (cost, audit, turns): after each row, the best for each state of the pattern; inserts are edits like others."""
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    states = {"": (0, "", ())}

    def inserts(now):
        for _ in range(3):
            for f, (cost, audit, turns) in list(now.items()):
                for t in "ua":
                    if (f, t) in legal:
                        way = (cost + 3, audit + "I", (*turns, (NAMES[t], "")))
                        if t not in now or way[:2] < now[t][:2]:
                            now[t] = way
        return now

    for (_, role, text), fault in zip(rows, bad):
        after = {}
        # one insert before a row at most is ever needed, and it must be weighed with the row's own edit
        for f, (cost, audit, turns) in states.items():
            ways = [(f, cost + 4, audit + "D", turns)]
            if fault not in ("blank", "duplicate"):
                for g, (c, a, x) in {f: (cost, audit, turns), **{t: (cost + 3, audit + "I", (*turns, (NAMES[t], ""))) for t in "ua" if (f, t) in legal}}.items():
                    late = 3 if fault == "truncated" else 0
                    if (g, role[:1]) in legal:
                        ways.append((role[:1], c + late, a + "K", (*x, (role, text))))
                    ways += [(t, c + 3 + late, a + "R", (*x, (NAMES[t], text))) for t in "ua" if (g, t) in legal]
            for t, *way in ways:
                if t not in after or tuple(way[:2]) < after[t][:2]:
                    after[t] = tuple(way)
        states = after
    return min((v for k, v in inserts(states).items() if k in ("", "a")), key=lambda v: v[:2])


def every_way(rows, bad):
    """As edit_by_edit(), by trying all choices; for a few rows."""
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in bad]
    for picked in itertools.product(*choices):
        for holes in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for k, hole in enumerate(holes):
                for x in hole:
                    cost, audit = cost + 3, audit + "I"
                    turns.append((NAMES[x], ""))
                if k < len(rows):
                    edit = picked[k]
                    audit += edit[0]
                    cost += {"D": 4, "K": 0, "R": 3}[edit[0]] + (3 if edit[0] != "D" and bad[k] == "truncated" else 0)
                    if edit != "D":
                        turns.append((rows[k][1] if edit == "K" else NAMES[edit[1]], rows[k][2]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)) and "" not in [r for r, _ in turns] and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, tuple(turns))
    return best


def wanted(rows):
    out = []
    for conv, mine in damaged(rows).items():
        bad = faults(mine)
        known = [t for t, _, _ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, turns = edit_by_edit(mine, bad)
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        out.append((conv, gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def talk(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"]
    texts = ["Yes.", "No!", "Why?", "it goes on", "é日本.", " ", None, "", "Well. \n", "\x1f", "ok . \x0b\t", "x" * 40]
    good = "system user assistant".split() if n % 2 else ["user", "assistant"]
    for k in range(n):
        turn = None if rng.random() < 0.05 else k + (k > n // 2) * 3 - (rng.random() < 0.1)
        role = good[k % len(good)] if rng.random() < 0.6 else rng.choice(roles)
        text = f"Turn {k} of {conv}." if rng.random() < 0.6 else rng.choice(texts)
        yield from [(conv, turn, role, text)] * (3 if rng.random() < 0.05 else 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [r for conv in range(120) for r in talk(rng, conv, rng.randint(1, 9))]
    out += [r for conv in (None, 500, 501, -7) for r in talk(rng, conv, 150)]
    out += [(600, None, None, None)] * 30 + [(601, 1, "user", "a"), (602, 5, "user", "Long. " * 200_000 + "end."), (602, 6, "assistant", "Short.")]
    out += [(603, k, "assistant" if k % 2 else "user", "the same words again.") for k in range(90)]
    # a conversation whose only row the damage drops
    gone = next(c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rng.shuffle(out)
    return [*out, (gone, 0, "user", "Dropped.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "c", "f") for r in rows], COLUMNS).repartition(4)


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("block_rows", [1, 7, conversations.BLOCK_ROWS])
def test_repair(spark, rows, block_rows):
    found = conversations.repair(conversations.damaged(frame(spark, rows)), block_rows)
    order = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found.columns == order
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted(rows), key=key)


def test_brute_force_is_right():
    rng = random.Random(3)
    for conv in range(60):
        (mine,) = damaged(list(talk(rng, conv, rng.randint(1, 3)))[:4]).values()
        bad = faults(mine)
        if len(mine) <= 4:
            assert edit_by_edit(mine, bad) == every_way(mine, bad)


def test_repaired_turns_have_the_pattern(spark, rows):
    for block_rows in (3, conversations.BLOCK_ROWS):
        found = conversations.repaired_turns(conversations.damaged(frame(spark, rows)), block_rows).collect()
        of = {}
        for x in sorted(found, key=lambda x: (x.part, x.block, x.place)):
            of.setdefault(x.conv_id, []).append((x.role, x.text))
        for conv, mine in damaged(rows).items():
            assert tuple(of.get(conv, ())) == edit_by_edit(mine, faults(mine))[2]
            assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in of.get(conv, ())))


def test_no_conversations(spark):
    assert conversations.repair(conversations.damaged(frame(spark, []))).count() == 0
