"""Facts, memories, runs, cases, metadata, rows and late reranking on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from querywell.operators import records


def test_facts_by_hand(spark):
    rows = [(1, "q", "【cause】 a leak\nthat grew 【next】x【effect】"), (2, "q", "cause： plain text【x】y"), (3, "q", "nothing"), (4, "q", None), (5, "q", "【effect】only this"), (6, "q", "【cause】\n【effect】e.g. one")]
    got = records.facts(spark.createDataFrame(rows, "id int, question string, answer string").selectExpr("*", "1 body", "2 section"), ["cause", "effect"])
    assert sorted((r["id"], r["content"]) for r in got.collect()) == [(1, "cause: a leak\nthat grew"), (2, "cause: plain text"), (5, "effect: only this"), (6, "effect: e.g. one")]
    assert records.facts(spark.createDataFrame(rows, "id int, question string, answer string"), []).count() == 0


def test_memories_and_runs_are_kept_once(spark, tmp_path):
    store = records.Records(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("fact", "a", "q", 5), ("fact", "b", "q", 6)], "kind string, content string, question string, at long")
    store.remember(one, 0)
    store.remember(one, 0)
    store.remember(one.withColumn("at", F.lit(9)), 1)
    assert sorted((r["content"], r["at"]) for r in store.memories().collect()) == [("a", 5), ("b", 6)]
    assert store.history().count() == 0
    for n, scores in enumerate([[0.9, 0.1], [None, 0.7], []], 2):
        store.save_run(spark.createDataFrame([(k, s) for k, s in enumerate(scores)], "case_id int, score double"), f"run{n}", "t", n, n)
    last = {r["run_id"]: (r["total"], r["passed"], r["failed"], r["average"]) for r in store.history(2).collect()}
    assert last == {"run3": (2, 1, 1, pytest.approx(0.7)), "run4": (0, 0, 0, 0.0)}
    assert [(r["case_id"], r["score"]) for r in store.details("run2").orderBy("case_id").collect()] == [("0", 0.9), ("1", 0.1)]


def test_cases_metadata_and_rows(spark):
    texts = ["{}", json.dumps({"id": 7, "expected_min_sources": "3", "tags": None, "expected_keywords": ["a"], "extra": 1}), "[]", "broken", None]
    got = [r["c"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(records.case_from_json(F.col("t")).alias("c")).collect()]
    assert got[2:] == [None] * 3 and got[0]["expected_intent"] == "rag_query" and got[0]["tags"] == [] and got[0]["source"] == "seed"
    assert (got[1]["id"], got[1]["expected_min_sources"], got[1]["tags"], got[1]["expected_keywords"]) == ("7", 3, [], ["a"])
    raw = json.dumps({"a": 1, "b": 2.5, "c": "x", "d": True, "e": None, "f": [1], "g": {"h": 1}, "_late_chunk_dense": [1]})
    held = spark.createDataFrame([(raw,), ("[1]",), (None,)], "m string").select(records.scalar_metadata(F.col("m")).alias("m")).collect()
    assert held[0]["m"] == {"a": "1", "b": "2.5", "c": "x", "d": "true"} and held[1]["m"] is None and held[2]["m"] is None
    lines = [("| a | b ||", ["a", "b"]), ("a\tb c\t", ["a", "b c"]), ("a  b   c", ["a", "b", "c"]), ("a b", []), ("", [])]
    cells = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(lines)], "k int, x string").orderBy("k").select(records.row_cells(F.col("x")).alias("c")).collect()
    assert [r["c"] for r in cells] == [want for _, want in lines]
    flags = spark.createDataFrame([(True, None), (True, []), (True, [0.0]), (False, None), (None, None)], "c boolean, s array<double>").select(records.should_refuse(F.col("c"), F.col("s")).alias("r")).collect()
    assert [r["r"] for r in flags] == [True, True, False, False, False]


def test_late_rerank_leaves_the_rest_alone(spark):
    hits = spark.createDataFrame([(1, "bad", 1), (1, "good", 2), (1, "third", 3), (2, "good", 1), (2, "bad", 2)], "qid int, id string, rank int")
    queries = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [])], "qid int, tokens array<array<double>>")
    documents = spark.createDataFrame([("good", [[1.0, 0.0], [0.0, 1.0]]), ("bad", [[-1.0, 0.0], [0.0, -1.0]]), ("third", [[1.0, 0.0]])], "id string, tokens array<array<double>>")
    got = {(r["qid"], r["id"]): (r["place"], r["score"], r["applied"]) for r in records.late_rerank(hits, queries, documents, 2).collect()}
    assert got == {(1, "good"): (1, 1.0, True), (1, "bad"): (2, 0.0, True), (1, "third"): (3, None, False), (2, "good"): (1, None, False), (2, "bad"): (2, None, False)}


def test_memories_that_share_words_with_a_question(spark):
    questions = spark.createDataFrame([(1, "how does the pump valve leak"), (2, "of it"), (3, None)], "id int, question string")
    memories = spark.createDataFrame([("m1", "Pump notes", 1), ("m2", "valve and pump leak", 1), ("m3", "a valve", 9), ("m4", "other thing", 5), ("m5", None, 1)], "memory string, content string, weight int")
    got = {r["id"]: r["memories"] for r in records.enriched(questions, memories, k=2).collect()}
    assert got == {1: ["m2", "m3"], 2: [], 3: []}
    assert records.enriched(questions.limit(0), memories).count() == 0


def test_procedures_need_a_role_for_each_clause(spark):
    from querywell.operators import channels

    units = spark.createDataFrame([(d, c, "s", "Do it.") for d in (1, 2, 3, 4) for c in (0, 1)], "doc int, clause int, source string, body string")
    roles = spark.createDataFrame([(1, 0, "scope"), (1, 1, "step"), (2, 0, "scope"), (3, 0, "scope"), (3, 1, "step"), (3, 2, "step"), (4, 0, "scope"), (4, 1, None), (5, 0, "scope")], "doc int, clause int, role string")
    assert sorted((r["doc"], r["clause"], r["role"]) for r in channels.with_roles(units, roles, "doc").collect()) == [(1, 0, "scope"), (1, 1, "step")]
