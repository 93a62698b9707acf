"""Source divergence against brute force: odd texts and names, colliding digests, many small buckets and blocks of sources."""

import collections
import random
import re

import numpy as np
import pytest

from graphloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOW))


def wanted(rows, least_docs, top=10):
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = terms_of(text)
        counts[lang, source].update(found)
        docs.update((lang, t) for t in set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for x, t in docs if x == lang and docs[x, t] >= least_docs)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in sources - {s}}
            term = {t: f(p[s][t], q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]}
            for part, values, limit in (("pair", pair, None), ("term", term, top)):
                for rank, (item, value) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:limit], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeéßж日Z") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    out = [(None, None, None), ("", "", ""), ("...\n", "en", "only marks"), ("\x00\x7fab\x80Ä[Z]{z}", "en", "s1"), ("lonely", "xx", "one source"), (None, "yy", "a"), (None, "yy", "b")]
    for _ in range(400):
        lang, source = rng.choice((None, "en", "en", "de")), rng.choice((None, "s1", "s1", "s2", "é", "Z", "s10"))
        mine = words[: 40 if source == "s1" else 80]
        out.append((rng.choice((" ", "-", "\t", "1")).join(rng.choice(mine) for _ in range(rng.randint(0, 40))), lang, source))
    # a text of several pieces, and a term that is longer than a piece
    out.append((" ".join(rng.choice(words) for _ in range(1_400_000)) + " " + "x" * (divergence.AT_ONCE + 100), "de", "s2"))
    return out


@pytest.mark.parametrize(("least_docs", "entries", "pairs"), [(10, divergence.BUCKET_ENTRIES, divergence.TASK_PAIRS), (1, 7, 9), (3, 1, 1)])
def test_audit(spark, rows, monkeypatch, least_docs, entries, pairs):
    monkeypatch.setattr(divergence, "TASK_PAIRS", pairs)
    docs = spark.createDataFrame([(*r, "b", 1) for r in rows], "text string, lang string, source string, bucket string, total long").repartition(3)
    found = divergence.audit(docs, least_docs=least_docs, bucket_entries=entries)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == wanted(rows, least_docs)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


@pytest.mark.parametrize("digest", [divergence.xxhash.xxh64_intdigest, len, lambda x: 0, lambda x: x[0]])
def test_terms_of_texts(digest):
    rng = random.Random(1)
    texts = ["", "a", "A a b", "Éa-éA", "no1two", "end ", *(" ".join("".join(rng.choice("abAé") for _ in range(rng.randint(1, 4))) for _ in range(30)) for _ in range(20))]
    distinct, code, text = divergence.terms([t.encode() for t in texts], digest)
    assert len(set(distinct)) == len(distinct)
    found = [[] for _ in texts]
    for c, t in zip(code.tolist(), text.tolist()):
        found[t].append(distinct[c].decode())
    assert found == [terms_of(t) for t in texts]


def test_exact_arithmetic():
    rng = random.Random(2)
    of = [rng.randint(1, 9 * 10**15) for _ in range(500)] + [1, 2, 9 * 10**15]
    n = [rng.randint(0, x) for x in of]
    assert divergence.scaled(np.array(n), np.array(of)).tolist() == [1 + 10**9 * a // b for a, b in zip(n, of)]
    p, q = [rng.randint(1, 10**9 + 1) for _ in range(500)], [rng.randint(1, 10**9 + 1) for _ in range(500)]
    assert divergence.divergence(np.array(p), np.array(q)).tolist() == [(a - b) ** 2 // (a + b) for a, b in zip(p, q)]
