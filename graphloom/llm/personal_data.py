"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF for the forms that they miss.

The model is trained in numpy on the driver from a bounded number of labelled spans and goes to the executors as one small file.
A text is cut into overlapping windows at fixed places; each window is decoded by Viterbi, and the spans of all windows of a text
are reconciled together: pieces that a window's edge cuts are joined with what its neighbour found, and of spans that overlap
the set with the greatest sum of scores stays. A span has to have a sign (a digit, an @ or a bracketed "at"), so windows without
one need not be decoded; that changes no result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_shipped, prepare, ship_arrays, text_of
from graphloom.llm.personal_samples import labelled_spans

KINDS = ("email", "ip", "card", "phone")
#: At most this many labelled texts are used, of at most WINDOW characters each.
MAX_LABELLED = 4000
WINDOW, STRIDE = 128, 64
#: Units of each direction; passes over the labelled texts, texts of a step, rate of a step.
HIDDEN, EPOCHS, BATCH, RATE = 24, 12, 128, 0.02
#: Windows decoded together.
WINDOWS_AT_ONCE = 512
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
SIGN = re.compile(r"[0-9@]|[\[({<] ?at ?[\])}>]", re.IGNORECASE)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match starts where a run of digits starts, for the one before it ended with its run; so no run is tried twice
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern: before each @ all characters a name may have, down to the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at)):
            yield start, found.end()
            free = found.end()
        free = max(free, at + 1)
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, in order; kinds may overlap each other, spans of one kind don't."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


# Characters are seen as classes: ASCII in lower case, all digits alike, other letters, other characters, and nothing.
OTHER_LETTER, OTHER, NOTHING, CLASSES = 128, 129, 130, 131
_ASCII = np.array([ord("0") if chr(i).isdigit() else ord(chr(i).lower()) for i in range(128)], np.int64)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.full(len(points), OTHER, np.int64)
    ascii_ = points < 128
    out[ascii_] = _ASCII[points[ascii_]]
    for i in np.flatnonzero(~ascii_).tolist():
        if text[i].isalpha():
            out[i] = OTHER_LETTER
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _run(seen: np.ndarray, recur: np.ndarray, keep: bool = False):
    """States (time, direction, row, unit) from the gates' inputs (time, direction, row, 4 units); with what a backward pass needs."""
    steps, _, rows, wide = seen.shape
    h = wide // 4
    state, cell = np.zeros((2, rows, h), np.float32), np.zeros((2, rows, h), np.float32)
    out, kept = np.empty((steps, 2, rows, h), np.float32), []
    for t in range(steps):
        z = seen[t] + state @ recur
        gates, new = _sigmoid(z[..., : 3 * h]), np.tanh(z[..., 3 * h :])
        old, cell = cell, gates[..., h : 2 * h] * cell + gates[..., :h] * new
        squashed = np.tanh(cell)
        if keep:
            kept.append((gates, new, old, squashed, state))
        state = out[t] = gates[..., 2 * h :] * squashed
    return out, kept


def _both(x: np.ndarray) -> np.ndarray:
    """(time, row) as (time, direction, row), the second direction from the end."""
    return np.stack([x, x[::-1]], axis=1)


def emissions(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(time, row, tag) scores of class sequences (time, row)."""
    states, _ = _run(_inputs(model, x), model["recur"])
    return states[:, 0] @ model["out"][0] + states[::-1, 1] @ model["out"][1] + model["bias"]


def _inputs(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    both = _both(x)
    return np.stack([model["seen"][0][both[:, 0]], model["seen"][1][both[:, 1]]], axis=1)


def decode(model: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most probable tags (time, row) by Viterbi, and how much each position's tag is above `outside` by its emission."""
    score = emissions(model, x)
    best, back = score[0] + model["start"], np.empty(score.shape, np.int8)
    for t in range(1, len(score)):
        way = best[:, :, None] + model["moves"]
        back[t] = way.argmax(axis=1)
        best = way.max(axis=1) + score[t]
    tags = np.empty(x.shape, np.int8)
    tags[-1] = best.argmax(axis=1)
    rows = np.arange(x.shape[1])
    for t in range(len(score) - 1, 0, -1):
        tags[t - 1] = back[t][rows, tags[t]]
    return tags, np.take_along_axis(score, tags[..., None].astype(np.int64), 2)[..., 0] - score[..., 0]


def _gradient(model: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss (negative log likelihood of tags y, mean over rows) and its gradient; x, y: (time, row)."""
    states, kept = _run(_inputs(model, x), model["recur"], keep=True)
    ahead, behind = states[:, 0], states[::-1, 1]
    score = (ahead @ model["out"][0] + behind @ model["out"][1] + model["bias"]).astype(np.float64)
    moves, start, (steps, rows) = model["moves"].astype(np.float64), model["start"], x.shape
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = score[0] + start
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + moves, 1) + score[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(moves + (score[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _log_sum(alpha[-1], 1)
    share = np.exp(alpha + beta - total[None, :, None])
    pairs = np.exp(alpha[:-1, :, :, None] + moves + (score[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]).sum(axis=(0, 1))
    picked = np.take_along_axis(score, y[..., None], 2).sum() + moves[y[:-1], y[1:]].sum() + start[y[0]].sum()
    d_score = share.copy()
    np.put_along_axis(d_score, y[..., None], np.take_along_axis(share, y[..., None], 2) - 1, 2)
    d_moves, d_start = pairs, share[0].sum(axis=0)
    np.add.at(d_moves, (y[:-1], y[1:]), -1)
    np.add.at(d_start, y[0], -1)
    d_score = (d_score / rows).astype(np.float32)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    grad = {
        "moves": d_moves / rows, "start": d_start / rows, "bias": d_score.sum(axis=(0, 1)),
        "out": np.stack([flat(ahead).T @ flat(d_score), flat(behind).T @ flat(d_score)]),
    }
    above = np.stack([d_score @ model["out"][0].T, (d_score @ model["out"][1].T)[::-1]], axis=1)
    h = model["recur"].shape[1]
    d_recur, d_seen = np.zeros_like(model["recur"]), np.empty((steps, 2, rows, 4 * h), np.float32)
    d_state, d_cell = np.zeros((2, rows, h), np.float32), np.zeros((2, rows, h), np.float32)
    back = model["recur"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        gates, new, old, squashed, before = kept[t]
        i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
        d_state = d_state + above[t]
        d_cell = d_cell + d_state * o * (1 - squashed**2)
        z = np.concatenate([d_cell * new, d_cell * old, d_state * squashed], axis=-1) * gates * (1 - gates)
        z = np.concatenate([z, d_cell * i * (1 - new**2)], axis=-1)
        d_recur += before.transpose(0, 2, 1) @ z
        d_seen[t], d_state, d_cell = z, z @ back, d_cell * f
    both = _both(x)
    grad["recur"], grad["seen"] = d_recur, np.zeros_like(model["seen"])
    for k in (0, 1):
        at = both[:, k].ravel()
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        grad["seen"][k, at[order][first]] = np.add.reduceat(flat(d_seen[:, k])[order], first)
    return float((total.sum() - picked) / rows), grad


def fit(labelled: Iterable[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """A model from (text, [(start, end, kind)]): the first MAX_LABELLED texts, each cut to its first WINDOW characters; Adam."""
    rng, rows = np.random.default_rng(seed), []
    for text, spans in labelled:
        x, y = np.full(WINDOW, NOTHING, np.int64), np.zeros(WINDOW, np.int64)
        x[: len(text)] = classes(text[:WINDOW])
        for a, b, kind in spans:
            y[a:b] = 2 + 2 * KINDS.index(kind)
            y[a : a + 1] = 1 + 2 * KINDS.index(kind)
        rows.append((x, y))
        if len(rows) == MAX_LABELLED:
            break
    xs, ys = np.array([r[0] for r in rows]).reshape(-1, WINDOW), np.array([r[1] for r in rows]).reshape(-1, WINDOW)
    lengths = (xs != NOTHING).sum(axis=1)
    small = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
    model = {"seen": small(2, CLASSES, 4 * HIDDEN), "recur": small(2, HIDDEN, 4 * HIDDEN), "out": small(2, HIDDEN, TAGS)}
    model |= {"bias": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
    model["seen"][..., HIDDEN : 2 * HIDDEN] += 0.5  # cells remember at first
    m, v, step = {k: np.zeros_like(a) for k, a in model.items()}, {k: np.zeros_like(a) for k, a in model.items()}, 0
    total = epochs * -(-len(xs) // BATCH)
    for _ in range(epochs):
        # texts of like length share a step, which is as long as the longest of them and a little more
        order = np.argsort(lengths + rng.random(len(xs)) * 8, kind="stable")
        for pick in rng.permuted(np.arange(-(-len(xs) // BATCH))).tolist():
            pick = order[pick * BATCH : (pick + 1) * BATCH]
            step, longest = step + 1, min(WINDOW, lengths[pick].max() + 4)
            _, grad = _gradient(model, xs[pick, :longest].T, ys[pick, :longest].T)
            rate = RATE * (1 - 0.95 * step / total) * min(1, step / 20)
            scale = min(1.0, 5 / (1e-9 + np.sqrt(sum(float((g**2).sum()) for g in grad.values()))))
            for k, g in grad.items():
                g = (g * scale).astype(np.float32)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                model[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    # what is no sequence of tags: inside after another kind or after nothing
    for k in range(2, TAGS, 2):
        model["moves"][[t for t in range(TAGS) if t not in (k - 1, k)], k] = -1e4
        model["start"][k] = min(model["start"][k], 0)  # a window may begin inside
    return model


@lru_cache(maxsize=2)
def default_model(epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """The model of the labelled spans that are made by rule, once for each process."""
    return fit(labelled_spans(MAX_LABELLED), epochs)


def _spans_of(tags: np.ndarray, above: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(start, end, kind, score) of one window's tags."""
    start, kind = -1, -1
    for t, tag in enumerate([*tags.tolist(), 0]):
        if start >= 0 and (tag == 0 or tag % 2 == 1 or (tag - 1) // 2 != kind):
            yield start, t, kind, float(above[start:t].sum())
            start = -1
        if start < 0 and tag:
            start, kind = t, (tag - 1) // 2


def reconcile(found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) without overlaps from the spans of all windows of a text: (start, end, kind, score, cut by an edge).

    A cut span is joined with the spans of its kind that it overlaps; then the set with the greatest sum of scores is taken, of
    equal ones that of the later spans first left out.
    """
    joined: list[list] = []
    last: dict[int, list] = {}  # of each kind the one that reaches furthest
    for start, end, kind, score, cut in sorted(found):
        other = last.get(kind)
        if other and start <= other[1] and (cut or other[4]):
            # the piece that is not cut knows the end; two cut ones are parts of one
            other[1], other[3] = (max(other[1], end) if other[4] or not cut else other[1]), max(other[3], score)
            other[4] = other[4] and cut
        else:
            joined.append([start, end, kind, score, cut])
            if not other or end >= other[1]:
                last[kind] = joined[-1]
    joined.sort(key=lambda x: (x[1], x[0]))
    ends = [x[1] for x in joined]
    best: list[float] = [0.0]
    for i, (start, _, _, score, _) in enumerate(joined):
        best.append(max(best[i], score + best[int(np.searchsorted(ends[:i], start, side="right"))]))
    out, i = [], len(joined)
    while i:
        start, end, kind, score, _ = joined[i - 1]
        before = int(np.searchsorted(ends[: i - 1], start, side="right"))
        if score > 0 and best[i] == score + best[before] and best[i] > best[i - 1]:
            out.append((start, end, kind))
            i = before
        else:
            i -= 1
    return out[::-1]


def windows(text: str) -> list[int]:
    """Where the windows with a sign start, of those that start at each multiple of STRIDE."""
    if not text:
        return []
    last = max(0, -(-(len(text) - WINDOW) // STRIDE)) * STRIDE
    out: dict[int, None] = {}
    for m in SIGN.finditer(text):
        for k in range(max(0, -(-(m.end() - WINDOW) // STRIDE)), min(last, m.start() // STRIDE * STRIDE) // STRIDE + 1):
            out[k * STRIDE] = None
    return list(out)


def found_spans(model: dict[str, np.ndarray], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The model's (start, end, kind) of each whole text."""
    places = [(i, at) for i, text in enumerate(texts) for at in windows(text)]
    found: dict[int, list] = {}
    for a in range(0, len(places), WINDOWS_AT_ONCE):
        some = places[a : a + WINDOWS_AT_ONCE]
        x = np.full((len(some), WINDOW), NOTHING, np.int64)
        for row, (i, at) in enumerate(some):
            seen = classes(texts[i][at : at + WINDOW])
            x[row, : len(seen)] = seen
        tags, above = decode(model, x.T)
        for row in np.flatnonzero(tags.any(axis=0)).tolist():
            i, at = some[row]
            for start, end, kind, score in _spans_of(tags[:, row], above[:, row]):
                start, end = start + at, min(end + at, len(texts[i]))
                cut = (start == at > 0) or (end == at + WINDOW < len(texts[i]))
                if start < end:
                    found.setdefault(i, []).append((start, end, kind, score, cut))
    trimmed = [[_trimmed(text, *s) for s in reconcile(found[i])] if i in found else [] for i, text in enumerate(texts)]
    return [[s for s in spans if _plausible(text, *s)] for text, spans in zip(texts, trimmed)]


def _trimmed(text: str, start: int, end: int, kind: int) -> tuple[int, int, int]:
    """Without marks at the end, and at the start without those that none of the kinds begins with."""
    while end > start and not text[end - 1].isalnum():
        end -= 1
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    return start, end, kind


def _plausible(text: str, start: int, end: int, kind: int) -> bool:
    """An exact check of what the model names: a whole token with a sign and as many digits or marks as the kind has at least."""
    if not SIGN.search(text, start, end) or text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum():
        return False
    span = text[start:end]
    digits = sum(c in "0123456789" for c in span)
    return (True, span.count(".") >= 3 or span.count(":") >= 2, 12 <= digits <= 19, 7 <= digits <= 15)[kind]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))


def find_personal_data(docs: DataFrame, model: dict[str, np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, text, spans (start, end, kind, base) by start, then kind; in characters, end exclusive.

    Base spans are those of the fixed patterns; of the model's spans those stay that overlap none of them. A null text is empty
    and has no spans; a null id stays null; repeated rows each have their row; texts of any length are whole; an empty table
    gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    name = ship_arrays(docs.sparkSession, "personal-data", **{k: a.ravel() for k, a in (model or default_model()).items()})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = {"seen": (2, CLASSES, -1), "recur": (2, HIDDEN, -1), "out": (2, HIDDEN, TAGS), "moves": (TAGS, TAGS)}
        here = {k: np.array(a).reshape(shapes.get(k, -1)) for k, a in map_shipped(name).items()}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for text, more in zip(texts, found_spans(here, texts)):
                base = base_spans(text)
                spans = [(a, KINDS.index(k), b, True) for a, k, b in base]
                reach = list(accumulate((b for _, _, b in base), max))  # how far the base spans up to each one reach
                for a, b, k in more:
                    before = bisect_left(base, (b,))  # those that start before the span ends
                    if not before or reach[before - 1] <= a:
                        spans.append((a, k, b, False))
                rows.append([{"start": a, "end": b, "kind": KINDS[k], "base": own} for a, k, b, own in sorted(spans)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, SPANS)], names=["doc_id", "text", "spans"])

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return made.mapInArrow(find, "doc_id long, text string, spans array<struct<start:long,end:long,kind:string,base:boolean>>")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """The numbers and digests of find_personal_data(): counts and base_sha256 are of base spans, `spans` lists all."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(found: DataFrame) -> DataFrame:
    """doc_id and text with each stretch of personal data as its kind in brackets; overlapping spans are one stretch, of the first one's kind."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), between.otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return found.select("doc_id", F.aggregate("spans", start, step, end).alias("text"))
