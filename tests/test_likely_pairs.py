"""Sets are joined with their tokens only where places and bitmaps say that they may be similar."""

import random

from graphloom.operators import prefixes, similarity


def similar(sets, least):
    return {(a, b) for a, x in sets for b, y in sets if a < b and x != y and len(x & y) / len(x | y) >= least}


def test_sets_that_share_a_rare_token_only_are_not_joined(spark, monkeypatch):
    # the rarest tokens are shared by all, nothing else is; two pairs are similar
    sets = [(k, {"a", "b"} | {f"w{k}-{j}" for j in range(12)}) for k in range(40)]
    sets += [(100 + k, {w for w in sets[k][1] if w != f"w{k}-3"} | {f"v{k}"}) for k in (0, 1)]
    df = spark.createDataFrame([(k, "x", sorted(s)) for k, s in sets] + [(200, None, ["a"]), (201, "x", [])], "id long, lang string, tokens array<string>")
    names, plain = {}, similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: (names.update({name: df.count()}), plain(df, name))[1])
    found = {(r.id_a, r.id_b) for r in similarity.near_pairs(df).collect()}
    assert found == similar(sets, 0.6) == {(0, 100), (1, 101)}
    assert names["likely-pairs"] < 40


def test_frequent_tokens_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(2)
    sets = [(k, set(rng.choices([f"t{j}" for j in range(18)], k=rng.randint(2, 12)))) for k in range(150)]
    least = {}
    for k, s in sets:
        least.setdefault(frozenset(s), k)
    wanted = similar([(k, set(s)) for s, k in least.items()], 0.6)
    df = spark.createDataFrame([(k, "x", sorted(s)) for k, s in sets], "id long, lang string, tokens array<string>")
    assert {(r.id_a, r.id_b) for r in similarity.near_pairs(df).collect()} == wanted
    # in tasks of their own: groups of two blocks, batches and steps that cut groups
    import numpy as np
    import pyarrow as pa

    for name, value in (("GROUP", 7), ("STEP", 11), ("ROWS", 5)):
        monkeypatch.setattr(prefixes, name, value)
    words = sorted({w for _, s in sets for w in s})
    hashes = dict(zip(words, np.random.default_rng(3).integers(-(2**63), 2**63 - 1, len(words)).tolist()))
    counts = np.bincount(prefixes.bucket(np.array([hashes[w] for _, s in sets for w in s])), minlength=prefixes.BUCKETS)
    rows = pa.record_batch([pa.array([k for k, _ in sets]), pa.array([[hashes[w] for w in s] for _, s in sets])], names=["no", "hashes"])
    laid = pa.Table.from_batches(list(prefixes.laid_out(counts, 0.6, iter([rows])))).sort_by("key")
    sizes = {}
    for key in laid["key"].to_pylist():
        sizes[key] = sizes.get(key, 0) + 1
    assert max(sizes.values()) < 100 and laid.num_rows > len(sets)
    pairs = pa.Table.from_batches(list(prefixes.likely_pairs(0.6, iter(laid.to_batches(max_chunksize=3))))).to_pydict()
    assert similar(sets, 0.6) <= set(zip(pairs["a"], pairs["b"]))
