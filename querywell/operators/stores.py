"""Stores as tables: what is appended, promoted, looked up and folded over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import cut


def appended(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and the rows of new whose key is neither empty nor known; of repeated keys the first in order of the row."""
    fresh = new.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "").join(old.select(key), key, "left_anti").select(*old.columns)
    first = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c) for c in old.columns if c != key)))).where("__n = 1").drop("__n")
    return old.unionByName(first)


def registry_verdict(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """asked and registry (collection, model, dimension, sparse) -> collection, reason: compatible, or the first thing that differs."""
    r = registry.select(F.col("collection").alias("__c"), *(F.col(c).alias(f"__{c}") for c in ("model", "dimension", "sparse")))
    reason = F.when(F.col("__c").isNull(), "registry_missing").when(F.col("__model") != F.col("model"), "model_mismatch").when(F.col("__dimension") != F.col("dimension"), "dimension_mismatch")
    reason = reason.when(F.col("__sparse") != F.col("sparse"), "sparse_mismatch").otherwise("compatible")
    return asked.join(r, F.col("collection") == F.col("__c"), "left").select("collection", reason.alias("reason"))


def updated_embeddings(entities: DataFrame, new: DataFrame) -> DataFrame:
    """entities (id, source, embedding) and new (id, embedding): set by id in all sources; empty vectors set nothing."""
    some = new.where(F.size("embedding") > 0).select(F.col("id").alias("__id"), F.col("embedding").alias("__new"))
    return entities.join(some, F.col("id") == F.col("__id"), "left").select("id", "source", F.coalesce("__new", "embedding").alias("embedding"))


def access_counts(memories: DataFrame, reads: DataFrame) -> DataFrame:
    """memories (id, count) and reads (id): a read adds one."""
    n = reads.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    return memories.join(n, F.col("id") == F.col("__id"), "left").select("id", (F.col("count") + F.coalesce("__n", F.lit(0))).alias("count"))


def merged_state(left: Column, right: Column) -> Column:
    """Two maps as one; the right one wins."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def service_modes(events: DataFrame, by: str, order: str, service: Column, up: Column) -> DataFrame:
    """Events that tell whether a service (llm, retriever) is up -> by, order, mode after each.

    While the llm is down the mode leaves full for cached, else while the retriever
    is down for simplified; both up bring it back to full. A mode that was left
    stays until then: so it is that of the first event since all were up.
    """
    at = Window.partitionBy(by).orderBy(order)
    last = lambda name: F.coalesce(F.last(F.when(service == name, up), ignorenulls=True).over(at), F.lit(True))
    state = events.withColumn("__llm", last("llm")).withColumn("__retriever", last("retriever"))
    state = state.withColumn("__fine", F.col("__llm") & F.col("__retriever"))
    state = state.withColumn("__run", F.sum(F.col("__fine").cast("int")).over(at))
    wanted = F.when(~F.col("__llm"), "cached").when(~F.col("__retriever"), "simplified")
    first = F.first(F.when(~F.col("__fine"), wanted), ignorenulls=True).over(Window.partitionBy(by, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return state.select(by, order, F.when(F.col("__fine"), "full").otherwise(first).alias("mode"))


def promoted_candidates(golden: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """golden (id, query, reference) and candidates (id, query, corrected) -> the new golden set and the candidates left.

    A candidate becomes case fb_<id>; one without a corrected answer stays a candidate.
    """
    ready = candidates.where(F.coalesce(F.trim("corrected"), F.lit("")) != "")
    cases = ready.select(F.concat(F.lit("fb_"), F.col("id").cast("string")).alias("id"), "query", F.col("corrected").alias("reference"))
    return appended(golden, cases, "id"), candidates.join(ready.select("id"), "id", "left_anti")


def chunk_of(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """keys (id, source) and chunks (id, source, ordinal, chunk): the first chunk of each key, null without any."""
    first = chunks.groupBy("id", "source").agg(F.min_by("chunk", "ordinal").alias("chunk"))
    return keys.join(first, ["id", "source"], "left")


def raw_chunks(nodes: DataFrame, provenance: DataFrame, k: int) -> DataFrame:
    """nodes (qid, node, rank) and provenance (node, ordinal, source, chunk) -> qid, source, chunk, place.

    Nodes in their order, chunks of each in theirs, each (source, chunk) once, to k.
    """
    met = nodes.join(provenance, "node")
    first = met.groupBy("qid", "source", "chunk").agg(F.min(F.struct("rank", "ordinal")).alias("__at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("__at", "source", "chunk"))).where(F.col("place") <= k).drop("__at")


def neighbour_chunks(scores: DataFrame, seeds: DataFrame, edges: DataFrame, chunks: DataFrame, k: int, decay: float = 0.5) -> DataFrame:
    """Chunks of the neighbours of each query's seeds, by mean seed score x decay x weight.

    scores (qid, score): the mean over all entities in scope; seeds (qid, id);
    edges (src, dst, weight) in both directions; chunks (id, chunk). Ties by chunk.
    The seeds are read twice, so they are written first: the search behind them runs once.
    """
    seeds = cut(seeds)
    near = seeds.join(edges, seeds["id"] == edges["src"]).groupBy("qid", F.col("dst").alias("id")).agg(F.max("weight").alias("weight"))
    near = near.join(seeds, ["qid", "id"], "left_anti")
    scored = near.join(chunks, "id").join(scores, "qid").select("qid", "id", "chunk", F.round(F.col("score") * decay * F.col("weight"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id", "chunk"))).where(F.col("rank") <= k)


def corpus_digest(rows: DataFrame, by: str, order: str, body: Column, block: int = 4096) -> DataFrame:
    """by, digest: sha256 over the rows of a group in order, an integer from 0 without repeats.

    Each text is digested by itself, then the digests of ``block`` neighbours together, and those once more, so that no list of a
    group holds texts, or more than its own ``block`` digests; the last one holds a digest for each block * block places.
    """
    level = rows.select(by, F.col(order).cast("long").alias("place"), F.sha2(body, 256).alias("digest"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), "|"), 256).alias("digest")
    for _ in range(2):
        level = level.groupBy(by, F.expr(f"place div {block}").alias("block")).agg(joined).withColumnRenamed("block", "place")
    return level.groupBy(by).agg(joined)
