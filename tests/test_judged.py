"""Ranges, what may be sent, extraction replies, replay scores and corrective search on small fixtures."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from querywell.operators import extraction, ranges, replay, wire
from querywell.operators.workflow import corrective_search
from querywell.plans.planner import evidence_state


def test_prefixes_and_quantiles_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 2.0, 2.0, rng.random(), None])) for _ in range(500)] + [("c", None), ("d", 4.0)]
    table = spark.createDataFrame(rows, "g string, v double")
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    want = {}
    for g, vs in groups.items():
        vs.sort()
        n = len(vs)
        middle = (vs[(n - 1) // 2] + vs[n // 2]) / 2
        want[g] = (n, vs[max(0, -(-95 * n // 100) - 1)], vs[0], pytest.approx(middle))
    got = ranges.quantiles(table, ["g"], "v", {"p95": 0.95, "least": 0.0}, {"median": 0.5}).collect()
    assert {r["g"]: tuple(r)[1:] for r in got} == want
    whole = ranges.quantiles(table, [], "v", {"p50": 0.5}).collect()
    every = sorted(v for vs in groups.values() for v in vs)
    assert [(r["n"], r["p50"]) for r in whole] == [(len(every), every[-(-len(every) // 2) - 1])]
    numbers = spark.createDataFrame([(k, (k * 7) % 11) for k in range(40)], "k int, x int")
    placed = ranges.prefixes(numbers, [F.col("k").asc()], {"s": F.col("x")}, {"m": F.col("x")}).orderBy("k").collect()
    xs = [(k * 7) % 11 for k in range(40)]
    assert [(r["s"], r["m"]) for r in placed] == [(sum(xs[:k]), max(xs[:k]) if k else None) for k in range(40)]
    assert ranges.quantiles(table.limit(0), ["g"], "v", {"p": 0.5}).count() == 0


def test_skyline_equals_all_comparisons(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(12), rng.randrange(12)) for k in range(80)] + [(98, None, 1), (99, 1, None)]
    known = [r for r in rows if None not in r]
    want = {k for k, q, p in known if not any(q2 >= q and p2 <= p and (q2 > q or p2 < p) for _, q2, p2 in known)}
    assert {r["k"] for r in ranges.skyline(spark.createDataFrame(rows, "k int, q int, p int"), "q", "p").collect()} == want


def nested(levels):
    return {"a": nested(levels - 1)} if levels else 1


def test_what_may_be_sent(spark):
    assert wire.bounded({"x": 1, "vector": [1], "t": True, "n": None}) == ({"x": 1, "t": True, "n": None}, True)
    assert wire.bounded({"x": [1.5, float("nan"), float("inf"), "s"]}) == ({"x": [1.5, "s"]}, True)
    assert wire.bounded({"x": 2**64 - 1, "y": 2**64, "z": -(2**63), "w": -(2**63) - 1}) == ({"x": 2**64 - 1, "z": -(2**63)}, True)
    assert wire.bounded({"s": "x" * 4001}) == ({"s": "x" * 4000}, True) and wire.bounded({"s": "x" * 4000}) == ({"s": "x" * 4000}, False)
    assert wire.bounded({"x": list(range(65))}) == ({"x": list(range(64))}, True)
    assert wire.bounded({"x": 1, "deep": nested(5)}) == ({"x": 1, "deep": nested(5)}, False)
    assert wire.bounded({"x": 1, "deep": nested(6)}) == ({"x": 1}, True)
    assert wire.bounded({"x": {}, "y": []}) == ({"x": {}, "y": []}, False)
    for value in ({"a": nested(5)}, {"a": nested(6)}, {"embedding": 1}, {"x": ["y" * 4001]}, {"x": [0] * 65}, {"x": 2**64}, {"x": float("nan")}, [1, "two"]):
        assert wire.sendable(value) == (wire.bounded(value) == (value, False))
    rows = [(1, None), (2, "{}"), (3, "[1]"), (4, "{broken"), (5, '{"dense": [1]}'), (6, json.dumps({"é": "日本"}))]
    got = {r["k"]: tuple(r["s"]) for r in spark.createDataFrame(rows, "k int, m string").select("k", wire.wire_metadata("m").alias("s")).collect()}
    assert got == {1: ("{}", False), 2: ("{}", False), 3: ("{}", True), 4: ("{}", True), 5: ("{}", True), 6: ('{"é":"日本"}', False)}
    safe = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k int, m string").select("k", wire.wire_safe_json("m").alias("s")).collect()}
    assert safe == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True}


def test_extraction_replies(spark):
    good = {"entities": [{"name": " Pump ", "type": "Part", "description": "a {pump}"}, {"name": "pump", "type": "part"}, {"name": "Valve", "type": "Part"}, {"name": "", "type": "x"}, {"name": 7, "type": "Number"}, "no", {"type": "x"}], "relations": [{"src": "PUMP", "tgt": "valve", "type": "feeds"}, {"src": "pump", "tgt": "Valve", "type": "feeds"}, {"src": "pump", "tgt": "Tank", "type": "feeds"}, {"src": "pump", "tgt": "valve", "type": ""}, 5]}
    text = json.dumps(good)
    replies = [("plain", text), ("fenced", f"```json\n{text}\n```"), ("said", f"Sure! {text} Anything else?"), ("broken", text[:-3]), ("list", f"[{text}]"), ("none", None), ("empty", ""), ("other", '{"entities": {"a": 1}, "relations": "x"}'), ("nothing", "no object here")]
    got = {r["chunk_id"]: r for r in extraction.extracted(spark.createDataFrame([(k, "s", v) for k, v in replies], "chunk_id string, source string, reply string").selectExpr("*", "1 data", "2 entities", "3 names")).collect()}
    assert len(got) == len(replies)
    for k in ("plain", "fenced", "said"):
        assert [(e["name"], e["type"], e["description"]) for e in got[k]["entities"]] == [("Pump", "Part", "a {pump}"), ("Valve", "Part", ""), ("7", "Number", "")]
        ids = {e["name"]: e["id"] for e in got[k]["entities"]}
        assert [(r["src"], r["tgt"], r["type"]) for r in got[k]["relations"]] == [(ids["Pump"], ids["Valve"], "feeds")]
    for k in ("broken", "list", "none", "empty", "other", "nothing"):
        assert got[k]["entities"] == [] and got[k]["relations"] == [], k


def test_replay_scores_by_hand(spark):
    schema = "id long, answer string, reference_answer string, contexts array<string>, source_count int, answer_relevancy double, kind string"
    records = spark.createDataFrame(
        [(1, "The gap must be 5 mm. It runs；all day long；", "first thing；other thing", ["context one", "two"], 3, 0.5, "a"), (2, "No context for this one", None, [" "], None, None, "a"), (3, "", "only a reference", ["c"], None, 0.9, "b")],
        schema,
    )
    claims = replay.claim_rows(records)
    said = {(r["id"], r["part"], r["ordinal"]): (r["claim"], r["hard"]) for r in claims.collect()}
    assert said[1, "answer", 0] == ("The gap must be 5 mm. It runs", True) and said[1, "answer", 1] == ("all day long", False) and not any(k[0] == 2 for k in said)
    verdicts = spark.createDataFrame([(1, "answer", 0, False), (1, "answer", 1, True), (1, "reference", 0, True), (1, "reference", 1, None), (3, "reference", 0, True)], "id long, part string, ordinal int, supported boolean")
    relevant = spark.createDataFrame([(1, 1, False), (1, 2, True)], "id long, place int, relevant boolean")
    scores = replay.scored(records, replay.judged(claims, verdicts, relevant))
    by = {r["id"]: r for r in scores.collect()}
    assert (by[1]["faithfulness"], by[1]["hallucination_score"], by[1]["context_recall"], by[1]["context_precision"]) == (0.5, 1.0, 1.0, 0.5)
    assert by[1]["overall_score"] == pytest.approx((0.3 + 0.4 * 0.5 + 0.15 * 0.5 + 0.15 * 0.75) * 0.5)
    assert by[2]["faithfulness"] is None and by[2]["overall_score"] == 1.0 and by[2]["source_count"] == 1 and by[1]["source_count"] == 3
    assert by[3]["hallucination_score"] is None and by[3]["context_recall"] == 1.0
    report = {r["kind"]: r for r in replay.replay_report(scores, "kind").collect()}
    assert (report["a"]["total"], report["a"]["passed"], report["a"]["failed"], report["a"]["avg_faithfulness"], report["b"]["avg_faithfulness"]) == (2, 1, 1, 0.5, None)


def test_the_second_search_sees_only_what_failed(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid long")
    plans = queries.withColumn("retry_action", F.lit("wider"))
    hits = lambda rows: spark.createDataFrame(rows, "qid long, doc_id long, relevance double, conflict boolean")
    asked = []

    def first(qs):
        return hits([(1, 10, 0.9, False), (2, 20, 0.1, False), (3, 30, 0.9, True)]).join(qs, "qid", "left_semi")

    def second(qs):
        asked.extend(sorted(r["qid"] for r in qs.collect()))
        return hits([(1, 11, 0.9, False), (2, 21, 0.8, False), (4, 41, 0.2, False)]).join(qs, "qid", "left_semi")

    judge = lambda found: evidence_state(found, plans)
    rows = corrective_search(queries, first, second, lambda h: h, judge).collect()
    assert sorted((r["qid"], r["doc_id"], r["retried"], r["state"]) for r in rows) == [(1, 10, False, "accept"), (2, 21, True, "accept"), (3, 30, False, "conflict"), (4, 41, True, "weak")]
    assert asked == [2, 3, 4]
    calm = corrective_search(queries.where("qid = 1"), first, lambda qs: pytest.fail("no second search is due"), lambda h: h, lambda found: evidence_state(found, plans.where("qid = 1"))).collect()
    assert [(r["qid"], r["doc_id"], r["retried"]) for r in calm] == [(1, 10, False)]
