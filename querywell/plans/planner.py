"""Retrieval plans: a table of weights by class of query, masked by the channels' health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import facets, query_class

#: Class, dense, sparse, graph, summary, visual, reorder for diversity, more candidates, retry action.
PLANS = [
    ("exact", 0.3, 0.7, 0.0, 0.0, 0.0, False, False, "increase_sparse_budget"),
    ("procedure", 0.5, 0.5, 0.0, 0.0, 0.0, True, False, "multi_query"),
    ("comparison", 0.45, 0.4, 0.15, 0.0, 0.0, True, True, "retrieve_missing_facets"),
    ("multi_constraint", 0.45, 0.4, 0.15, 0.0, 0.0, True, True, "retrieve_missing_facets"),
    ("multi_hop", 0.4, 0.3, 0.3, 0.0, 0.0, True, True, "enable_graph_ppr"),
    ("global_summary", 0.4, 0.25, 0.0, 0.35, 0.0, True, True, "enable_raptor"),
    ("visual", 0.4, 0.3, 0.0, 0.0, 0.3, False, False, "enable_visual_or_ocr"),
    ("semantic", 0.5, 0.5, 0.0, 0.0, 0.0, True, False, "multi_query"),
    ("ambiguous", 0.5, 0.5, 0.0, 0.0, 0.0, True, False, "multi_query"),
]
CHANNELS = ("dense", "sparse", "graph", "summary", "visual")


def plan_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "query_class string, dense double, sparse double, graph double, summary double, visual double, use_mmr boolean, wide boolean, retry_action string")


def planned(queries: DataFrame, final_k: int = 5, healthy: dict[str, bool] | None = None) -> DataFrame:
    """(qid, query) -> class, facets, weights, budgets and flags of each query."""
    health = {c: True for c in CHANNELS} | (healthy or {})
    rows = queries.select("qid", "query", query_class(F.col("query")).alias("query_class"))
    rows = rows.join(F.broadcast(plan_table(queries.sparkSession)), "query_class")
    final = max(1, min(final_k, 200))
    rows = rows.withColumns({c: F.col(c) if health[c] else F.lit(0.0) for c in CHANNELS})
    split = F.when(F.col("query_class").isin("comparison", "multi_constraint"), facets(F.col("query"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "qid", "query_class", *CHANNELS, split.alias("facets"), F.when(F.col("wide"), max(12, final * 3)).otherwise(max(10, final * 2)).alias("candidate_k"),
        F.when(F.col("wide"), max(final * 2, 8)).otherwise(final).alias("rerank_k"), F.lit(final).alias("final_k"), (F.col("use_mmr") & F.lit(health["dense"])).alias("use_mmr"), "retry_action",
        ((F.col("query_class") == "ambiguous") | (sum((F.col(c) for c in CHANNELS), F.lit(0.0)) <= 0)).alias("degraded"),
    )


def evidence_state(hits: DataFrame, plans: DataFrame, threshold: float = 0.35) -> DataFrame:
    """hits (qid, relevance, conflict) -> empty, conflict, weak or accept, and the action for a retry."""
    found = hits.groupBy("qid").agg(F.max("relevance").alias("relevance"), F.max("conflict").alias("conflict"), F.count(F.lit(1)).alias("n"))
    rows = plans.select("qid", "retry_action").join(found, "qid", "left")
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "empty").when(F.col("conflict"), "conflict").when(F.col("relevance").isNull() | (F.col("relevance") < threshold), "weak").otherwise("accept")
    return rows.select("qid", state.alias("state"), F.when(state != "accept", F.col("retry_action")).alias("retry_action"))
