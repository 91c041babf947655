"""Where a query once did less than the whole job."""

import numpy as np
import pytest

from querywell.operators import graph
from querywell.streaming import replies


def test_pagerank_converges_to_the_plain_ranks(spark):
    rng = np.random.default_rng(8)
    weights = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 6, 14), rng.integers(6, 12, 14), rng.integers(1, 5, 14))}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src long, dst long, weight double")
    seeds = [0, 3, 99]  # the last is a dead end
    got = graph.pagerank(edges, spark.createDataFrame([(s,) for s in seeds], "id long"), rounds=100).collect()
    matrix, seed = np.zeros((100, 100)), np.zeros(100)
    for (a, b), w in weights.items():
        matrix[a, b] = matrix[b, a] = w
    seed[seeds] = 1 / 3
    total = matrix.sum(axis=1)
    step, ranks = matrix / np.where(total > 0, total, 1)[:, None], seed
    for _ in range(500):
        ranks = 0.15 * seed + 0.85 * (ranks @ step + ranks[total == 0].sum() * seed)
    assert all(r["converged"] for r in got) and len(got) == len({x for e in weights for x in e} | set(seeds))
    assert all(r["rank"] == pytest.approx(ranks[r["id"]], abs=1e-5) for r in got)
    short = graph.pagerank(edges, spark.createDataFrame([(0,)], "id long"), rounds=2).collect()
    assert short and not any(r["converged"] for r in short)


def test_pagerank_needs_few_rounds(spark):
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(rng.integers(0, 40, 160), rng.integers(40, 60, 160))], "src long, dst long, weight double").dropDuplicates()
    seeds = spark.createDataFrame([(0,), (1,)], "id long")
    got = {r["id"]: r for r in graph.pagerank(edges, seeds, rounds=40).collect()}
    assert all(r["converged"] for r in got.values()) and sum(r["rank"] for r in got.values()) == pytest.approx(1, abs=1e-5)
    links = {(r["src"], r["dst"]) for r in graph.adjacency(edges).collect()}
    degree = {a: sum(1 for x, _ in links if x == a) for a, _ in links}
    for b in got:
        flow = sum(got[a]["rank"] / degree[a] for a, x in links if x == b)
        assert got[b]["rank"] == pytest.approx(0.15 * (b in (0, 1)) / 2 + 0.85 * flow, abs=1e-5)


def test_replies_are_read_without_a_call_a_stream(spark):
    said = '{"conditions":[],"answer":[{"text":"a \\\\ \\" ]} b","source_ids":[1]},{"text":"c","source_ids":[]}]}'
    rows = [(f"s{n}", k, said[5 * k : 5 * k + 5], "stop" if 5 * k + 5 >= len(said) else None) for n in range(30) for k in reversed(range(-(-len(said) // 5)))]
    found = replies.paragraphs(spark.createDataFrame(rows, "stream_id string, seq long, piece string, finish string"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    got = sorted((r["stream_id"], r["paragraph"]["text"] if r["paragraph"] else "", r["status"] or "") for r in found.collect())
    assert got == sorted(x for n in range(30) for x in ((f"s{n}", 'a \\ " ]} b', ""), (f"s{n}", "c", ""), (f"s{n}", "", "complete")))
