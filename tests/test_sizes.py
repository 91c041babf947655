"""Steps whose time or memory must not grow faster than their input."""

import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querywell.operators import batches, extraction, graph, lexical, pagerank, ranking, splitting, state


def test_entities_without_the_work_for_relations(spark):
    odd = {"entities": [{"name": {"a": 1}, "type": "Part"}, None, {"name": "Pump", "type": ["x"], "description": 1.5}, [], {"name": "pump ", "type": '["x"]'}, {"name": None, "type": "Part"}], "relations": None}
    rows = [("odd", "s", f"\t```JSON\n{json.dumps(odd)}\n```\n"), ("brace", "s", '"{}"'), ("late", "s", 'x {"entities": [{"name": "A", "type": "b"}]} y } z'), ("none", "s", None)]
    replies = spark.createDataFrame(rows, "chunk_id string, source string, reply string")
    alone, whole = extraction.extracted_entities(replies), extraction.extracted(replies)
    got = {r["chunk_id"]: [tuple(e)[1:] for e in r["entities"]] for r in alone.collect()}
    assert got == {"odd": [('{"a":1}', "Part", ""), ("Pump", '["x"]', "1.5")], "brace": [], "late": [("A", "b", "")], "none": []}
    assert sorted(alone.collect()) == sorted(whole.select(*alone.columns).collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "relations" not in plan(alone) and "schema" not in plan(whole).lower()


def test_texts_go_in_parts_of_bounded_size():
    texts = ["a" * 10, None, "", "b" * 300, "c" * 60, "d" * 40, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    got = list(batches.parts(iter([batch, batch.slice(0, 0), batch.slice(2)]), size=100))
    assert [p.column("id").to_pylist() for p in got] == [[0, 1, 2], [3], [4, 5], [6], [2], [3], [4, 5], [6]]
    assert [t for p in got[:4] for t in p.column("text").to_pylist()] == texts


def test_chunks_leave_a_task_few_texts_at_a_time(spark):
    docs = spark.createDataFrame([(k, None if k == 3 else f"one {k}. two. " * 20) for k in range(50)], "doc_id long, text string").coalesce(1)
    rows = docs.mapInArrow(lambda b: (pa.RecordBatch.from_arrays([pa.array([len(p)])], ["n"]) for p in batches.parts(b, size=1000)), "n long").collect()
    assert len(rows) >= 10 and sum(r["n"] for r in rows) == 50
    plan = splitting.semantic_chunks(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    got = {r["doc_id"]: r["n"] for r in splitting.recursive_chunks(docs, 60, 0).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {k: len(splitting.recursive_pieces(f"one {k}. two. " * 20, 60, 0)) for k in range(50) if k != 3}


def test_many_queries_share_a_reading_of_the_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, None if k == 9 else " ".join(rng.choices(words, k=rng.randrange(30)))) for k in range(120)]
    asked = [(k, " ".join(rng.choices(words, k=3))) for k in range(100)] + [(100, None), (None, "w1")]
    table, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, query string")
    want = set()
    for q, query in asked[:100]:
        scored = sorted((-sum(Counter((t or "").split())[w] for w in query.split()), str(d), d) for d, t in docs)
        want |= {(q, d, float(-s), r) for r, (s, _, d) in enumerate(scored[:4], 1) if s < 0}
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    found = lexical.sparse_topk(table, queries, 4)
    assert {tuple(r) for r in found.collect()} == want and reads(found) == 1
    monkeypatch.setattr(lexical, "TOGETHER", 3)
    again = lexical.sparse_topk(table, queries, 4)
    assert {tuple(r) for r in again.collect()} == want and reads(again) == 3


def test_links_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 20)
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(12)]), rng.choice([None, 0.0, -1.0, 2.0, 5.0])) for _ in range(300)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    want = {}
    for a, b, w in rows:
        for pair in ((a, b), (b, a)):
            want[pair] = max(want.get(pair, 0.0), max(w or 1.0, 0.0))
    found = graph.adjacency(edges)
    got = found.collect()
    assert {(r["src"], r["dst"]): r["weight"] for r in got} == want and len(got) == len(want)
    assert found.rdd.getNumPartitions() == 15 and graph.adjacency(edges, 1000).rdd.getNumPartitions() == 50
    seeds = spark.createDataFrame([(3,)], "id long")
    near = {b for a, b in want if a == 3 and b is not None} - {3}
    hops = {r["id"]: r["hops"] for r in graph.reach(edges, seeds, 1).where("id is not null").collect()}
    assert hops == {3: 0} | {k: 1 for k in near}


def test_shared_words_make_no_pairs(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, None), (4, "a fox, red; hen")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Red hen red"), (2, "x"), (3, "cow")], "qid long, query string")
    found = lexical.shared_words(docs, asked, 2)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 1.0, 1), (1, 4, 1.0, 2)]


def test_summaries_are_scored_without_a_row_for_each_term(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rng = random.Random(11)
    words = ["red", "fox", "a", "图", "Hen", "xred", "foxes"]
    nodes = [(k, rng.choice([None, 1, 2]), None if k == 7 else " ".join(rng.choices(words, k=rng.randrange(9)))) for k in range(60)] + [(60, 1, "xred a foxes")]
    asked = [(0, "Red a fox"), (1, "red fox red"), (2, "图a"), (3, "cow"), (4, None), (5, ". "), (6, "hen")] + [(k, " ".join(rng.choices(words, k=3))) for k in range(7, 20)]
    terms = lambda x: {w for w in lexical._TERM.findall((x or "").lower())}
    want = set()
    for q, query in asked:
        scored = []
        for d, level, body in nodes:
            shared = len(terms(query) & terms(body))
            if shared:
                score = (shared + (query.lower() in body.lower())) / (len(terms(query)) + 1)
                scored.append((-score, -(level or 0), d))
        want |= {(q, d, round(-s, 6), r) for r, (s, _, d) in enumerate(sorted(scored)[:4], 1)}
    found = ranking.summary_scored(spark.createDataFrame(nodes, "id long, level int, text string"), spark.createDataFrame(asked, "qid long, query string"), 4)
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1


def test_a_summary_holds_a_query_that_ends_within_its_words(spark):
    nodes = spark.createDataFrame([(1, 1, "xred a foxes"), (2, 1, "red a hen")], "id long, level int, text string")
    got = ranking.summary_scored(nodes, spark.createDataFrame([(1, "Red a fox")], "qid long, query string"), 5).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 0.5, 1), (1, 2, 0.5, 2)]


def test_a_search_whose_hits_are_read_twice_runs_once(spark, sf_dir):
    from querywell.plans import catalogue

    for name in ("facet_retrieval", "late_rerank", "neighbour_chunks", "graph_retrieve"):
        plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("FlatMapCoGroupsInArrow") == (name == "facet_retrieval")  # hits that were written are a scan


def test_a_hit_that_leads_for_one_of_its_keys_leads_for_all(spark):
    rows = [(1, 1, "a", 1, ["x"]), (1, 2, "b", 2, ["x"]), (1, 1, "c", 3, ["x", "x"]), (1, 3, "a", 4, ["y"]), (1, 4, "d", 5, ["y"]), (1, 5, "e", 6, None), (2, 9, None, 1, [])]
    got = ranking.selected(spark.createDataFrame(rows, "qid long, id long, key string, rank int, matched array<string>"), 9).collect()
    assert sorted((r["qid"], r["place"], r["id"], r["key"]) for r in got) == [(1, 1, 1, "a"), (1, 2, 1, "c"), (1, 3, 4, "d"), (1, 4, 2, "b"), (1, 5, 5, "e"), (2, 1, 9, None)]


@pytest.mark.parametrize("name", ["page_text_topk", "corrective_search_authority"])
def test_a_task_counts_two_megabytes_of_text_at_a_time(spark, sf_dir, monkeypatch, name):
    from querywell.plans import catalogue

    tasks, frame, sizes = [], type(spark.range(0)), []
    run, counted = frame.mapInArrow, lexical.Blocks.counted
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: tasks.append(f) or run(self, f, *a, **k))
    catalogue.queries()[name](spark, sf_dir)
    monkeypatch.setattr(lexical.Blocks, "counted", lambda self, texts: sizes.append(sum(map(len, texts))) or counted(self, texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["some words " * 1000] * 600), pa.array([0.0] * 600)], ["doc_id", "text", "level"])
    for task in tasks:
        list(task(iter([batch])))
    assert tasks and sum(sizes) == len(tasks) * 600 * 11000 and max(sizes) <= batches.BYTES


def plain_ranks(rows, seeds):
    """Ranks by plain steps over a matrix, and the names of its rows; links without an end are none."""
    names = sorted({x for a, b, w in rows if None not in (a, b) and (w is None or w >= 0) for x in (a, b)} | set(seeds))
    matrix, seed = np.zeros((len(names), len(names))), np.array([(x in seeds) / len(seeds) for x in names])
    for a, b, w in rows:
        if None not in (a, b):
            i, j = names.index(a) if a in names else None, names.index(b) if b in names else None
            if i is not None and j is not None:
                matrix[i, j] = matrix[j, i] = max(matrix[i, j], w or 1.0, 0.0)
    total = matrix.sum(axis=1)
    step, ranks = matrix / np.where(total > 0, total, 1)[:, None], seed
    for _ in range(400):
        ranks = 0.15 * seed + 0.85 * (ranks @ step + ranks[total == 0].sum() * seed)
    return dict(zip(names, ranks))


def test_ranks_by_tiles_of_links(spark, monkeypatch):
    """Many small tiles, one of them split, a hub, links to itself, both ways and without an end, and seeds without links."""
    monkeypatch.setattr(pagerank, "TILE", 40)
    monkeypatch.setattr(pagerank, "PIECE", 16)
    rng = random.Random(11)
    rows = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice([None, 0.0, 2.0, 5.0])) for _ in range(150)]
    rows += [("hub", f"n{k % 60}", 1.0 + k % 3) for k in range(120)] + [("n1", "n1", 3.0), (None, "n2", 1.0), ("n3", None, 1.0), ("gone", "also", -1.0), ("x", "y", 1.0)]
    rows += [(b, a, 4.0) for a, b, _ in rows[:30]]
    seeds = ["n1", "hub", "lone", "n1", None]
    want = plain_ranks(rows, {"n1", "hub", "lone"})
    edges, asked = spark.createDataFrame(rows, "src string, dst string, weight double"), spark.createDataFrame([(s,) for s in seeds], "id string")
    whole = pagerank.tiled
    monkeypatch.setattr(pagerank, "tiled", lambda e, kind, bands, blocks: whole(e, kind, 2, blocks))
    got = graph.pagerank(edges, asked, rounds=60).collect()
    assert len(got) == len(want) and all(r["converged"] for r in got)
    assert all(r["rank"] == pytest.approx(want[r["id"]], abs=1e-6) for r in got) and sum(r["rank"] for r in got) == pytest.approx(1, abs=1e-5)
    tiles = whole(edges, "string", 2, 12).where("low is not null").select("tile", (F.length("low") / 4).alias("n")).collect()
    pairs = {(min(a, b), max(a, b)) for a, b, w in rows if None not in (a, b) and w != -1}
    assert len({r["tile"] for r in tiles}) > 3 and max(r["n"] for r in tiles) <= 16 and sum(r["n"] for r in tiles) == len(pairs)
    none = graph.pagerank(edges.limit(0), asked, rounds=9).collect()
    assert {r["id"]: r["rank"] for r in none} == {s: pytest.approx(1 / 3) for s in ("n1", "hub", "lone")}


def test_ranks_in_fewer_rounds_that_move_no_links(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(a, 1000 + rng.randrange(30), 1.0) for a in range(400) for _ in range(12)]
    plans = []
    monkeypatch.setattr(pagerank, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or state.cut(df))
    edges = spark.createDataFrame(rows, "src long, dst long, weight double").distinct()
    got = graph.pagerank(edges, spark.createDataFrame([(0,), (1,)], "id int"), rounds=12).collect()
    want = plain_ranks([(a, b, w) for a, b, w in set(rows)], {0, 1})
    assert all(r["converged"] and r["rank"] == pytest.approx(want[r["id"]], abs=1e-6) for r in got) and len(got) == len(want)

    # A round deals out what blocks and tiles send and the state, but not the links or places of nodes, which it reads as they are kept.
    plan = plans[2]
    for step in ("FlatMapCoGroupsInArrow [tile", "FlatMapCoGroupsInArrow [block", "MapInArrow sent"):
        assert "Exchange" not in plan[plan.index(step) :].split("InMemoryRelation")[0]
