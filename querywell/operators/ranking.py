"""Dense search, fusion and re-ordering over batches of queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import authority_value, decay_factor, finite, probability, revision_digits, sigmoid, status_rank
from ..functions.text import terms
from .lexical import terms_and_whole
from .tiles import near_pairs

RRF_K, BLOCK = 60, 1024


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, by: str = "ip", keep: Column | None = None) -> DataFrame:
    """vectors (id, vec) and queries (qid, qvec) -> qid, id, score, rank; ties by the id as a string.

    Every query meets every vector, in tiles of bounded size (operators.tiles), each of which sends on what can be among the first k.
    """
    kept = vectors if keep is None else vectors.where(keep)
    scored = near_pairs(kept, queries, k, by).select("qid", "id", F.round("score", 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("id").cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(channels: list[tuple[DataFrame, float, bool]], k: int = RRF_K) -> DataFrame:
    """Ranked channels (qid, key, rank), their weights and whether they count though empty -> qid, key, score, rank.

    Weights are divided by the sum over enabled channels. A channel that counts
    only if it has rows (a graph) is left out of the sum for queries without any.
    """
    parts, sums = [], []
    for n, (df, weight, always) in enumerate(channels):
        parts.append(df.select("qid", "key", (F.lit(float(weight)) / (k + F.greatest(F.col("rank"), F.lit(1)))).alias("part")))
        if not always:
            sums.append(df.select("qid").distinct().select("qid", F.lit(float(weight)).alias("extra")))
    fixed = float(sum(w for _, w, always in channels if always))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    total = every.groupBy("qid", "key").agg(F.sum("part").alias("sum"))
    extra = None
    for s in sums:
        extra = s if extra is None else extra.unionByName(s)
    if extra is None:
        total = total.withColumn("weight", F.lit(fixed))
    else:
        total = total.join(extra.groupBy("qid").agg(F.sum("extra").alias("extra")), "qid", "left").withColumn("weight", F.lit(fixed) + F.coalesce("extra", F.lit(0.0)))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    return total.select("qid", "key", F.round(F.col("sum") / F.col("weight"), 9).alias("score")).withColumn("rank", F.row_number().over(order))


def min_max(df: DataFrame, group: str, value: str, out: str = "scaled") -> DataFrame:
    """Over each group's pool: missing is the pool's least, all equal is 0.5, no number at all is 0."""
    pool = Window.partitionBy(group)
    low, high = F.min(value).over(pool), F.max(value).over(pool)
    filled = F.coalesce(F.col(value), low)
    return df.withColumn(out, F.when(low.isNull(), 0.0).when(high == low, 0.5).otherwise((filled - low) / (high - low)))


def dual_sieve(df: DataFrame, group: str, logit: str, least: float = 0.35, least_scaled: float = 0.3) -> DataFrame:
    """Rows with a logit stay if both its probability and its place in the pool suffice; rows without bypass.

    If all reranked rows of a group fail though others exist, its best one stays.
    """
    pool = Window.partitionBy(group)
    low, high = F.min(logit).over(pool), F.max(logit).over(pool)
    scaled = F.when(high == low, 1.0).otherwise((F.col(logit) - low) / (high - low))
    passes = (sigmoid(F.col(logit)) >= least) & (scaled >= least_scaled)
    marked = df.withColumn("__pass", F.when(F.col(logit).isNull(), True).otherwise(passes)).withColumn("__ranked", F.col(logit).isNotNull())
    best = F.row_number().over(Window.partitionBy(group, "__ranked").orderBy(F.desc(logit), F.monotonically_increasing_id()))
    alive = F.max((F.col("__pass") & F.col("__ranked")).cast("int")).over(pool)
    kept = marked.withColumn("__best", best).withColumn("__alive", alive)
    return kept.where(F.col("__pass") | (F.col("__ranked") & (F.col("__alive") == 0) & (F.col("__best") == 1))).drop("__pass", "__ranked", "__best", "__alive")


def time_decayed(df: DataFrame, score: Column, age_days: Column) -> Column:
    return F.when(age_days.isNull(), score).otherwise(score * decay_factor(age_days))


def authority_order(df: DataFrame, group: str, relevance: str = "relevance", tie: str = "id") -> DataFrame:
    """status, authority, revision, effective_date -> rank: newest and most official first, then relevance."""
    order = [F.desc(status_rank(F.col("status"))), F.desc(authority_value(F.col("authority"))), F.desc(revision_digits(F.col("revision"))), F.desc(F.coalesce(F.unix_timestamp(F.col("effective_date").try_cast("timestamp")), F.lit(0)))]
    order += [F.desc(F.coalesce(F.col("revision"), F.lit(""))), F.desc(relevance), F.col(tie)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def version_conflicts(df: DataFrame) -> DataFrame:
    """Families with more than one revision of one authority among active rows."""
    active = df.where((status_rank(F.col("status")) == 2) & F.col("family").isNotNull() & F.col("revision").isNotNull())
    return active.groupBy("family", authority_value(F.col("authority")).alias("authority")).agg(F.count_distinct("revision").alias("revisions")).where("revisions > 1")


def parent_expanded(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits (qid, id, parent_id, text, score) -> the best child of each parent, with the parent's text if it is known.

    Children without a parent stay by themselves; missing scores come last.
    """
    key = F.when(F.col("parent_id").isNull(), F.concat(F.lit("orphan:"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("parent:"), F.col("parent_id").cast("string")))
    best = hits.withColumn("key", key).groupBy("qid", "key").agg(F.max_by(F.struct("id", "parent_id", "text", "score"), F.struct(F.coalesce("score", F.lit(float("-inf"))), -F.col("id"))).alias("h"))
    return best.select("qid", "key", "h.*").join(parents.select("parent_id", F.col("content")), "parent_id", "left").select("qid", "key", "id", "score", F.coalesce("content", "text").alias("content"))


def best_per_source(df: DataFrame, group: str, source: str, score: str, tie: str, k: int) -> DataFrame:
    first = Window.partitionBy(group, source).orderBy(F.desc(score), tie)
    kept = df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def mmr(pool: DataFrame, queries: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """pool (qid, id, vec, score), at most a few hundred rows a query -> qid, id, rank: chosen rows first, then the rest.

    Greedy, so it runs over one query's bounded pool in a task: relevance is half
    cosine and half min-max score, redundancy the largest cosine to a chosen row.
    """

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        x, q = unit(np.stack(rows["vec"]).astype(float)), unit(np.array([rows["qvec"].iloc[0]], dtype=float))[0]
        s = rows["score"].to_numpy(dtype=float)
        span = s.max() - s.min()
        relevance = 0.5 * (x @ q) + 0.5 * (np.full(len(s), 0.5) if span == 0 else (s - s.min()) / span)
        near, left, order = np.zeros(len(s)), list(range(len(s))), []
        while left and len(order) < k:
            gain = trade * relevance[left] - (1 - trade) * near[left]
            pick = left.pop(int(np.argmax(gain)))
            order.append(pick)
            near = np.maximum(near, x @ x[pick]) if len(order) > 1 else x @ x[pick]
        order += left
        return pd.DataFrame({"qid": rows["qid"].iloc[order].to_numpy(), "id": rows["id"].iloc[order].to_numpy(), "rank": np.arange(1, len(order) + 1)})

    return pool.join(queries, "qid").groupBy("qid").applyInPandas(choose, "qid long, id long, rank int")


def selected(hits: DataFrame, final_k: int) -> DataFrame:
    """hits (qid, id, key, rank, matched array<string>) -> one per key; first covers of facets, then by rank, to final_k."""
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("qid", "key").orderBy("rank"))).where("n = 1")
    # Windows only: a join of the hits with themselves would run the searches behind them twice.
    cover = first.select("qid", "id", "key", "rank", F.explode_outer("matched").alias("facet"))
    leads = F.col("facet").isNotNull() & (F.row_number().over(Window.partitionBy("qid", "facet").orderBy("rank")) == 1)
    marked = cover.withColumn("lead", F.when(leads, 0).otherwise(1)).withColumn("lead", F.min("lead").over(Window.partitionBy("qid", "id")))
    once = marked.groupBy("qid", "id", "key", "rank").agg(F.min("lead").alias("lead"))
    order = Window.partitionBy("qid").orderBy("lead", "rank")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= final_k).select("qid", "id", "key", "rank", "place")


def packed(df: DataFrame, group: str, tokens: str, score: str, tie: str, budget: int) -> DataFrame:
    """By score, until the running sum of tokens + 2 first overflows; the first row always stays."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    run = df.withColumn("used", F.sum(F.col(tokens) + 2).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    return run.where((F.col("used") <= budget) | (F.col("place") == 1))


def unweighted_rrf(variants: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, variant, key, rank) of several phrasings of a query -> sum of 1/(k+rank); ties by first appearance."""
    total = variants.groupBy("qid", "key").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("variant", "rank")).alias("seen"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seen")
    return total.withColumn("rank", F.row_number().over(order)).drop("seen")


def weighted_rrf(channels: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, channel, weight, key, rank) -> sum of weight / all weights of the query's channels / (k+rank); ties by first appearance."""
    first = F.row_number().over(Window.partitionBy("qid", "channel").orderBy("rank", "key")) == 1
    once = channels.withColumn("once", F.when(first, F.col("weight")).otherwise(0.0))
    every = once.withColumn("all", F.sum("once").over(Window.partitionBy("qid")))
    total = every.groupBy("qid", "key").agg(F.round(F.sum(F.col("weight") / F.col("all") / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("channel", "rank")).alias("seen"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seen")
    return total.withColumn("rank", F.row_number().over(order)).drop("seen")


def per_doc_select(df: DataFrame, group: str, score: str, tie: str, least: float = 0.3) -> DataFrame:
    """Rows with a score of ``least`` or more, else the best scored one; rows without a score stay and are marked degraded."""
    every = Window.partitionBy(group)
    best = F.row_number().over(every.orderBy(F.desc_nulls_last(score), tie))
    passed = F.sum((F.col(score) >= least).cast("int")).over(every)
    marked = df.withColumn("__best", best).withColumn("__passed", F.coalesce(passed, F.lit(0))).withColumn("degraded", F.col(score).isNull())
    return marked.where(F.col("degraded") | (F.col(score) >= least) | ((F.col("__passed") == 0) & (F.col("__best") == 1))).drop("__best", "__passed")


def hard_negatives(docs: DataFrame, positives: DataFrame, n: int, seed: str = "seed") -> DataFrame:
    """positives (qid, doc_id) -> for each query n other documents: those relevant to other queries first, then by sha256 of seed, query and id."""
    judged = positives.select("doc_id").distinct()
    # Documents that nobody judged are only tried for queries that the judged ones of others can't fill.
    own = positives.distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("own"))
    short = own.where(F.lit(judged.count()) - F.col("own") < n).select("qid")
    pools = [(judged, own.select("qid"), 0)]
    if short.limit(1).count():
        pools.append((docs.select("doc_id").join(judged, "doc_id", "left_anti"), short, 1))
    drawn = None
    for pool, queries, rank in pools:
        blocks = -(-queries.count() // BLOCK)
        for k in range(blocks):
            part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)
            block = part.agg(F.collect_list("qid").alias("qids"))
            some = pool.crossJoin(F.broadcast(block)).select(F.explode("qids").alias("qid"), "doc_id", F.lit(rank).alias("judged"))
            drawn = some if drawn is None else drawn.unionByName(some)
    rows = drawn.join(positives, ["qid", "doc_id"], "left_anti")
    order = Window.partitionBy("qid").orderBy("judged", F.sha2(F.concat_ws(":", F.lit(seed), F.col("qid").cast("string"), F.col("doc_id").cast("string")), 256))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def token_score_scaled(rows: DataFrame, by: str, score: str, out: str = "scaled") -> DataFrame:
    """Scores of a pool to 0..1 by its range; a pool of one score maps -1..1 to 0..1."""
    pool = Window.partitionBy(by)
    low, high = F.min(score).over(pool), F.max(score).over(pool)
    flat = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(score) + 1) / 2))
    return rows.withColumn(out, F.when(high - low > 1e-12, (F.col(score) - low) / (high - low)).otherwise(flat))


def relevance(rerank_probability: Column, graded: Column, rerank_score: Column, reranked: Column) -> Column:
    """The first valid of a probability, a grade and, if a reranker ran, its score through the logistic function."""
    raw = finite(rerank_score)
    return F.coalesce(probability(rerank_probability), probability(graded), F.when(reranked, sigmoid(raw)))


def packed_skipping(rows: DataFrame, by: str, order: str, key: str, cost: str, budget: int) -> DataFrame:
    """Each item of a group in order is kept if it still fits the budget; one that does not is skipped and later ones are tried.

    The fold runs over (order, key, cost) of one group's candidates, which a search has already bounded.
    """
    items = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(cost).cast("long").alias("c")))).alias("items"))
    kind = dict(rows.dtypes)[key]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(state: Column, item: Column) -> Column:
        fits = state["used"] + item["c"] <= budget
        return F.when(fits, F.struct((state["used"] + item["c"]).alias("used"), F.concat(state["kept"], F.array(item["k"])).alias("kept"))).otherwise(state)

    return items.select(by, F.aggregate("items", start, step).alias("s")).select(by, F.col("s.used").alias("used"), F.explode("s.kept").alias(key))


def summary_scored(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """nodes (id, level, text) and queries (qid, query) -> qid, id, score, rank.

    Score: distinct shared terms, and one more if the text holds the whole query, over the query's terms and one, to six decimals
    (that is, queries have fewer than a million terms). Ties by the highest level, then by id. The nodes are read where they lie.
    """
    hits = terms_and_whole(nodes.select(F.col("id").alias("doc_id"), "text", "level"), queries, k)
    asked = queries.select("qid", F.size(terms(F.col("query"))).alias("n"))
    return hits.join(asked, "qid").select("qid", F.col("doc_id").alias("id"), F.round(F.col("score") / (F.col("n") + 1), 6).alias("score"), "rank")


def uncovered(facets: Column, matched: Column) -> Column:
    """Facets that no hit's list of matched ones names."""
    return F.array_except(facets, F.flatten(matched))


def without_retrieved(memories: DataFrame, retrieved: DataFrame, text: str, prefix: int = 80) -> DataFrame:
    """Memories whose first characters no retrieved text begins with."""
    seen = retrieved.select(F.substring(text, 1, prefix).alias("__begin")).distinct()
    return memories.join(seen, F.substring(text, 1, prefix) == F.col("__begin"), "left_anti")
