"""The pipeline against a brute-force version of it."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import near_copies, simhash
from test_llm_operators import LOW, same, texts, verdict


def near_keepers(rows):
    """One row of each group of texts that 5-word Jaccard of 0.8 or more connects: that with the smallest id, null last."""

    def shingles(text):
        w = (text or "").translate(LOW).encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    best = {}
    for r, row in zip(root, rows):
        best[r] = min(best.get(r, row), row, key=lambda x: (x[0] is None, x[0] or 0))
    return list(best.values())


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    clean = [" ".join(rng.choice("alpha beta gamma delta omega sigma kappa".split()) + str(rng.randint(0, 9999)) for _ in range(80)) for _ in range(12)]
    clean += [clean[0], clean[1] + " ", clean[2].upper(), clean[3] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', clean[4] + " one", " ".join(clean[5].split()[:30] + clean[6].split()[:50])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*texts(), *clean])]
    rows += [rows[-3], (None, "no id " + clean[7] + clean[8], "en", "s", 1), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = sorted({(i, t) for i, t, *_ in rows if verdict(t)[1]}, key=lambda x: (x[0] is None, x[0] or 0))
    seen, once = set(), []
    for i, t in left:
        words = re.sub(r"[\x20\x09-\x0d]+", " ", t)
        if words not in seen:
            seen.add(words)
            once.append((i, t))
    near = near_keepers(once)
    assert len(left) > len(once) > len(near)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for i, t in near:
        ids = model.encode(t.replace("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "[SECRET]"), add_special_tokens=False).ids
        x = np.array([*ids, 2], "<u4")
        marks = [0, *range((len(x) - 1) % 1024 + 1, len(x) + 1, 1024)]
        wanted += [(i, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(marks, marks[1:]))]
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], wanted)
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_near_copies_are_those_of_five_words(spark):
    rng = random.Random(11)
    prose = lambda n: [rng.choice("abcdefgh") + str(rng.randint(0, 5000)) for _ in range(n)]
    made = []
    for k in range(12):
        base = prose(120)
        made.append(base)
        for edits in (1, 2, 3, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(120)] = f"new{rng.randint(0, 9999)}"
            made.append(copy)
    common = prose(60)
    made += [common + prose(k) for k in range(1, 40)]  # one large bucket: near ones and others share it
    rows = [(i, " ".join(w)) for i, w in enumerate(made)] + [(0, " ".join(made[0])), (3, " ".join(prose(90))), (None, "no id " + " ".join(prose(80)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [tuple(r) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    same(found, near_keepers(rows))
    assert len(found) < len(rows) - 30


def test_bitmaps_rule_out_no_near_pair():
    rng = random.Random(15)
    for _ in range(300):
        n, extra = rng.randint(1, 400), rng.randint(0, 100)
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate((a[: rng.randint(0, n)], np.array([rng.getrandbits(64) for _ in range(extra)], np.uint64))))
        if len(b):
            apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
            assert near_copies.bits_apart(near_copies.bitmap(a), near_copies.bitmap(b)) <= apart


@pytest.mark.parametrize("block", [near_copies.BLOCK, 3])
def test_pairs_in_buckets(spark, block):
    rng = random.Random(16)
    base = [rng.getrandbits(64) for _ in range(60)]
    sets = [np.unique(np.array([h if rng.random() < 0.93 else rng.getrandbits(64) for h in base[: rng.choice([40, 55, 60])]], np.uint64)) for _ in range(12)]
    nodes = spark.createDataFrame([(k, bytearray(near_copies.bitmap(s).tobytes())) for k, s in enumerate(sets)], "node long, bits binary")
    rows = spark.createDataFrame([(h, k, len(s), None, k if k else 1) for h in (1, 2) for k, s in enumerate(sets)], "h long, node long, n int, f int, root long")
    found = {tuple(r) for r in near_copies._plausible_in_buckets(rows, nodes, 0.8, block).collect()}
    near = {(a, b) for b in range(12) for a in range(b) if (a, b) != (0, 1) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert near and near <= found and (0, 1) not in found


def test_near_dedup_links_fingerprints_by_pigeonring(spark, monkeypatch):
    rng, asked = random.Random(17), []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **b: asked.append(b) or links(*a, **b))
    base = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
    rows = [(k, " ".join([*base[:k], "other", *base[k + 1 :]])) for k in (3, 200, 390)] + [(9, " ".join(f"x{k}" for k in range(90)))]
    found = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in found) == [3, 9] and asked == [{"distance": near_copies.DISTANCE}]


def test_fingerprint_pairs_connect_what_is_within_the_distance(spark):
    rng = random.Random(18)
    fps = [rng.getrandbits(64) for _ in range(6)]
    fps += [fps[0]] + [f ^ sum(1 << b for b in rng.sample(range(64), n)) for f in fps for n in (1, 3, 4, 5)]
    nodes = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "node long, fp long")
    for distance in (1, 3, 5):
        root = list(range(len(fps)))
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= distance:
                    root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        found = {r.node: r.root for r in simhash.components(near_copies._fingerprint_pairs(nodes, distance)).collect()}
        assert [found.get(k, k) for k in range(len(fps))] == root and len(set(root)) < len(root)


def test_a_large_group_gives_rows_for_members_not_for_pairs(spark):
    rng = random.Random(19)
    base = [f"w{k}" for k in range(100)]
    made = [" ".join(w if rng.random() < 0.975 else f"n{rng.randint(0, 10**6)}" for w in base) for _ in range(60)]
    sets = [near_copies.shingles(t) for t in made]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    nodes = docs.selectExpr("doc_id AS node", "unhex(sha2(text, 256)) AS digest").join(spark.createDataFrame([(k, bytearray(near_copies.bitmap(s).tobytes())) for k, s in enumerate(sets)], "node long, bits binary"), "node")
    rows = spark.createDataFrame([(h, k, len(s), None, k) for h in (1, 2) for k, s in enumerate(sets)], "h long, node long, n int, f int, root long")
    pairs = near_copies._plausible_in_buckets(rows, nodes, 0.8).count()
    members = near_copies.written(near_copies._plausible_in_buckets(rows, nodes, 0.8, ends=True), "members")
    assert members.count() <= 120 < pairs
    found = near_copies._linked_in_buckets(members, docs, nodes, 5, 0.8, "text")
    groups = {frozenset(k for k in range(60) if near_copies.near(sets[k], sets[a], 0.8)) for a in range(60)}
    while True:
        joined = {frozenset().union(*(h for h in groups if g & h)) for g in groups}
        if joined == groups:
            break
        groups = joined
    roots = {r.node: r.root for r in simhash.components(found).collect()}
    assert [roots.get(k, k) for k in range(60)] == [min(g) for k in range(60) for g in groups if k in g]
    assert found.count() == 60 - len(groups) < 59
