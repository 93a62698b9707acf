"""Searches score pairs in the tasks that have the rows: no pair is written or shuffled but the best."""

import math

from graphloom.operators import retrieval, search


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return 0.0
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


VECTORS = [(k, [1.0, 2.0] if k % 3 == 0 else [float(k % 5), float(k % 7)] if k % 4 else [0.0, 0.0] if k % 8 else [1.0, 2.0, 3.0]) for k in range(40)]


def test_vector_top_as_by_hand_without_a_join_of_all_pairs(spark):
    rows = spark.createDataFrame(VECTORS + [(99, None)], "id long, vector array<double>")
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "query")
    top = search.vector_top(rows, asked, 7)
    assert "NestedLoop" not in top._jdf.queryExecution().toString()
    for q in (0, 20):
        wanted = sorted(((-round(cosine(v, VECTORS[q][1]), 9), k) for k, v in VECTORS))[:7]
        assert [r.id for r in sorted(top.where(f"query = {q}").collect(), key=lambda r: r.rank)] == [k for _, k in wanted]


def test_semantic_top_as_by_hand_without_a_join_of_all_pairs(spark):
    rows = spark.createDataFrame(VECTORS, "id long, vector array<double>")
    degree = spark.createDataFrame([(k, k % 6) for k in range(0, 40, 2)], "id long, degree long")
    top = retrieval.semantic_top(rows, degree, rows.where("id = 21").withColumnRenamed("id", "query"), 5)
    assert "NestedLoop" not in top._jdf.queryExecution().toString()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) if len(a) == len(b) else 0.0
    share = lambda k: (k % 6) / 4 if k % 2 == 0 else 0.0
    wanted = sorted((-round(0.7 * dot(v, VECTORS[21][1]) + 0.3 * share(k), 9), k) for k, v in VECTORS)[:5]
    assert [r.id for r in sorted(top.collect(), key=lambda r: r.rank)] == [k for _, k in wanted]


def test_hybrid_search_writes_no_pairs(spark, monkeypatch):
    texts = [(k, f"word{k % 4} common thing{k}", v) for k, v in VECTORS] + [(98, "common", None), (99, None, None)]
    docs = spark.createDataFrame(texts, "id long, text string, vector array<double>")
    asked = docs.where("id % 10 = 0 OR id = 98").selectExpr("id AS query", "text", "vector")
    names, plain = [], search.written
    monkeypatch.setattr(search, "written", lambda df, name: (names.append((name, df.columns)), plain(df, name))[1])
    one = sorted(map(tuple, search.hybrid_search(docs, asked, 6).select("query", "id", "rank").collect()))
    assert not [n for n in names if {"query", "id"} <= set(n[1])]
    many = sorted(map(tuple, search.hybrid_search(docs, asked, 6, block=2).select("query", "id", "rank").collect()))
    assert one == many
    lexical = {}
    for r in search.bm25_scores(docs, asked).collect():
        lexical.setdefault(r.query, {})[r.id] = r.score
    by_id = {k: v for k, _, v in texts}
    for q, found in lexical.items():
        best = max(found.values())
        fit = [k for k in by_id if k in found or by_id[k] is not None and by_id[q] is not None]
        score = lambda k: 0.6 * min(max(cosine(by_id[k], by_id[q]), 0.0), 1.0) + 0.4 * found.get(k, 0.0) / best
        wanted = sorted((-round(score(k), 9), k) for k in fit)[:6]
        assert [i for q_, i, _ in sorted(one, key=lambda x: x[2]) if q_ == q] == [k for _, k in wanted]
