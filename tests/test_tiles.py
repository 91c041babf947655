"""Vector search by tiles gives what scoring every pair as a row gives, and sends on little."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from querywell.functions import vectors
from querywell.operators import ranking, tiles

VECTOR, QUERY = "id long, vec array<float>", "qid long, qvec array<float>"


def plain(found, asked, k, by):
    score = (vectors.dot if by == "ip" else vectors.cosine)(F.col("vec"), F.col("qvec"))
    pairs = found.crossJoin(asked).select("qid", "id", F.round(score, 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("id").cast("string"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@pytest.mark.parametrize("by", ["ip", "cosine"])
def test_tiles_equal_every_pair(spark, monkeypatch, by):
    monkeypatch.setattr(tiles, "VECTORS", 150)
    monkeypatch.setattr(tiles, "QUERIES", 20)
    rng = np.random.default_rng(5)
    rows = [r.tolist() for r in rng.normal(size=(300, 8)).round(1)]
    rows += [rows[0]] * 90 + [[x * (1 + 1e-8) for x in rows[1]] for _ in range(30)]  # copies and near ones
    rows += [None, [], [0.0] * 8, [1.0] * 5, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8, [-float("inf")] + [1.0] * 7, [1e30] * 8]
    found = spark.createDataFrame(list(enumerate(rows)), VECTOR)
    asked = spark.createDataFrame([(n, rows[n]) for n in [*range(0, 300, 9), *range(418, len(rows))]], QUERY)
    for k in (1, 10):
        got, want = (sorted(map(str, df.select("qid", "id", "score", "rank").collect())) for df in (ranking.dense_topk(found, asked, k, by), plain(found, asked, k, by)))
        assert got == want
    assert sorted(map(str, ranking.dense_topk(found.limit(4), asked, 10, by).collect())) == sorted(map(str, plain(found.limit(4), asked, 10, by).collect()))


def test_no_pair_but_the_near_ones_is_a_row(spark):
    rng = np.random.default_rng(6)
    rows = [r.tolist() for r in rng.normal(size=(1000, 8))] + [[1.0] * 8] * 1000
    found = spark.createDataFrame(list(enumerate(rows)), VECTOR)
    asked = found.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    assert tiles.near_pairs(found, asked, 10, "cosine").count() < 20 * 100  # of 200,000
    plan = ranking.dense_topk(found, asked)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_no_queries_and_no_vectors(spark):
    some = spark.createDataFrame([(1, [1.0])], VECTOR)
    assert not ranking.dense_topk(some, spark.createDataFrame([], QUERY)).count()
    assert not ranking.dense_topk(some.where("id > 1"), spark.createDataFrame([(1, [1.0])], QUERY)).count()


def test_tiles_of_long_vectors_hold_fewer_rows(spark, monkeypatch):
    monkeypatch.setattr(tiles, "NUMBERS", 800)
    rng = np.random.default_rng(8)
    rows = [r.tolist() for r in rng.normal(size=(200, 40)).round(2)] + [None, []]
    found = spark.createDataFrame(list(enumerate(rows)), VECTOR)
    asked = found.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    plan = tiles.near_pairs(found, asked, 3, "ip")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(id" in plan and ", 11)" in plan  # 202 rows, 20 a part
    got, want = (sorted(map(str, df.select("qid", "id", "score", "rank").collect())) for df in (ranking.dense_topk(found, asked, 3), plain(found, asked, 3, "ip")))
    assert got == want


@pytest.mark.parametrize("name", ["dense_topk_cosine", "entity_search", "semantic_seeds"])
def test_queries_of_similar_vectors_search_by_tiles(spark, sf_dir, name):
    from querywell.plans import catalogue

    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Join Inner" not in plan and "Join Cross" not in plan
