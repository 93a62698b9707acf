"""Personal data: fixed patterns and the tagger's parts against brute force, the tagger on texts it has not seen."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from graphloom.llm import personal_data as pii
from graphloom.llm.personal_samples import labelled_spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "card":
        doubled = [2 * d if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in found.split(".")), "phone": 9 <= len(digits) <= 15}[kind]


def plain(text):
    out = [(m.start(), list(PATTERNS).index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m.group())]
    return [(a, list(PATTERNS)[k], b) for a, k, b in sorted(out)]


def test_fixed_patterns():
    rng = random.Random(2)
    texts = ["".join(rng.choice("0123456789.@+-() aé%") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice(("a@b.c", "1.2.3.4", "256.", "0001", "4111 1111-1111 1111", "+1 (743) 555-3824", ".", "@", "x", " ", "é")) for _ in range(8)) for _ in range(4000)]
    texts += [t for t, _ in labelled_spans(500, 3)] + ["a@b.c@d.e", "@@a@b.cd", "1.2.3.4.5.6.7.8.9", "+1+2 345678901", "x.34@mail7.example.com."]
    for text in texts:
        assert pii.base_spans(text) == plain(text), text


def test_fixed_patterns_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1.x" * 200_000, "+1" + " " * 400_000, "@" * 200_000, "+1" * 200_000):
        assert pii.base_spans(text) == []


def tiny():
    rng = np.random.default_rng(4)
    shapes = {"seen": (2, pii.CLASSES, 4 * 3), "recur": (2, 3, 4 * 3), "out": (2, 3, pii.TAGS), "bias": (pii.TAGS,), "moves": (pii.TAGS, pii.TAGS), "start": (pii.TAGS,)}
    return {k: rng.standard_normal(s).astype(np.float32) for k, s in shapes.items()}, rng


def path_score(model, score, y):
    return score[np.arange(len(y)), y].sum() + model["start"][y[0]] + model["moves"][y[:-1], y[1:]].sum()


def test_viterbi_and_likelihood_are_those_of_all_paths():
    model, rng = tiny()
    x = rng.integers(0, pii.CLASSES, (4, 3))
    tags, _ = pii.decode(model, x)
    loss, _ = pii._gradient(model, x, tags.astype(np.int64))
    total = 0.0
    for row in range(3):
        score = pii.emissions(model, x)[:, row].astype(float)
        every = {y: path_score(model, score, np.array(y)) for y in itertools.product(range(pii.TAGS), repeat=4)}
        best = max(every, key=every.get)
        assert tuple(tags[:, row]) == best
        total += np.log(np.exp(list(every.values())).sum()) - every[best]
    assert loss == pytest.approx(total / 3, rel=1e-4)


def test_gradient_is_the_slope():
    model, rng = tiny()
    x, y = rng.integers(0, 5, (6, 2)), rng.integers(0, pii.TAGS, (6, 2))
    _, grad = pii._gradient(model, x, y)
    for name in model:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in model[name].shape) if name != "seen" else (rng.integers(0, 2), rng.integers(0, 5), rng.integers(0, 12))
            moved = []
            for step in (1e-2, -1e-2):
                other = {k: a.astype(np.float64) for k, a in model.items()}
                other[name][at] += step
                moved.append(pii._gradient(other, x, y)[0])
            assert grad[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-2, abs=2e-3), name


def test_reconcile():
    rng = random.Random(5)
    for _ in range(300):
        found = [(a, a + rng.randint(1, 6), rng.randrange(2), rng.choice((0.5, 1.0, 2.0, 3.25)), False) for a in (rng.randrange(20) for _ in range(rng.randint(0, 6)))]
        got = pii.reconcile(found)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
        worth = {}
        for a, b, k, s, _ in found:
            worth[a, b, k] = max(worth.get((a, b, k), 0), s)
        best = max(
            sum(worth[s] for s in some)
            for n in range(len(worth) + 1)
            for some in itertools.combinations(sorted(worth), n)
            if all(a[1] <= b[0] for a, b in itertools.combinations(some, 2))
        )
        assert sum(worth[s] for s in got) == best
    # a window's edge cuts a span, the next window has it whole
    assert pii.reconcile([(100, 128, 2, 5.0, True), (100, 135, 2, 6.0, False)]) == [(100, 135, 2)]
    assert pii.reconcile([(60, 128, 0, 5.0, True), (64, 150, 0, 6.0, True)]) == [(60, 150, 0)]


def test_windows_without_a_sign_change_nothing():
    model, rng = pii.default_model(), random.Random(6)
    texts = [t for t, _ in labelled_spans(40, 21)]
    long = " ".join(rng.choice(texts) if rng.random() < 0.3 else "none of it here" for _ in range(60))
    every = [k * pii.STRIDE for k in range(max(0, -(-(len(long) - pii.WINDOW) // pii.STRIDE)) + 1)]
    assert pii.windows(long) == [k for k in every if pii.SIGN.search(long[k : k + pii.WINDOW])]
    some = pii.found_spans(model, [long])
    old, pii.windows = pii.windows, lambda text: every
    try:
        assert pii.found_spans(model, [long]) == some
    finally:
        pii.windows = old


def test_held_out_accuracy():
    model, held = pii.default_model(), list(labelled_spans(1500, 77))
    found = pii.found_spans(model, [t for t, _ in held])
    wanted = [{(a, b, k) for a, b, k in spans} for _, spans in held]
    got = [{(a, b, pii.KINDS[k]) for a, b, k in spans} for spans in found]
    hit = sum(len(a & b) for a, b in zip(wanted, got))
    assert hit / sum(map(len, got)) > 0.93 and hit / sum(map(len, wanted)) > 0.92
    for kind in pii.KINDS:
        mine = [len([s for s in a & b if s[2] == kind]) for a, b in zip(wanted, got)]
        assert sum(mine) / sum(len([s for s in a if s[2] == kind]) for a in wanted) > 0.85, kind


def test_operator(spark):
    form = "card 5105 1051 0510 5100, ip 10.0.0.1, call (743) 555-3824 or a.b@c.de"
    rows = [(1, None), (2, ""), (3, form), (3, form), (None, form), (4, "naïve 日本 " * 50_000 + form), (5, "plain words, nothing else."), (6, "9" * 100_000), (7, "x@" * 3000)]
    docs = spark.createDataFrame([(i, t, "s", "b") for i, t in rows], "doc_id long, text string, spans string, base string").repartition(3)
    found = pii.summary(pii.find_personal_data(docs))
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = {(x.doc_id, x.base_sha256): x for x in found.collect()}
    assert found.count() == len(rows)
    for i, text in rows:
        base = plain(text or "")
        listed = [f"{k}:{a}:{b}" for a, k, b in base]
        x = got[i, hashlib.sha256(",".join(listed).encode()).hexdigest()]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == kind for _, k, _ in base) for kind in PATTERNS]
        assert set(listed) <= set(x.spans.split(",")) if listed else True
    at = form.index("(743)")
    assert all(f"phone:{at}:{at + 14}" in x.spans for x in got.values() if x.doc_id == 3)
    assert next(x for x in got.values() if x.doc_id == 5).spans == ""
    clean = {x.doc_id: x.text for x in pii.masked(pii.find_personal_data(docs)).collect()}
    assert clean[3] == "card [card], ip [ip], call [phone] or [email]" and clean[5] == rows[6][1] and clean[1] == ""
    assert pii.summary(pii.find_personal_data(docs.limit(0))).count() == 0
