"""Documents that hold a passage are found by a word of it, or compared to all where it has none."""

from graphloom.plans import evaluation_queries


def test_relevant_documents(spark, tmp_path):
    texts = {1: "xthe quick brownx fox", 2: "the quick brown", 3: "quick", 4: "a  b", 5: None, 6: "the quickest brown", 7: "ab a  b c", 8: ""}
    passages = {10: "the quick brown", 11: "quick", 12: "a  b", 13: "", 14: None, 15: "k b"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(passages.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wanted = {(q, i) for q, p in passages.items() for i, t in texts.items() if p is not None and t is not None and p in t}
    found = evaluation_queries._relevant(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
