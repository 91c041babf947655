"""Retrieval in several searches: one a facet, optional channels, a second pass, page vectors, ranks carried to chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions.vectors import dot
from .ranking import BLOCK, selected, weighted_rrf

SPANS = ArrayType(StructType().add("begin", IntegerType()).add("end", IntegerType()))
#: What makes a step a condition, and the titles of a procedure's blocks in their order.
CONSTRAINT = r"(?i)必须|须|不得|不能|禁止|仅|只有|才能|完成才|方可|不允许|\b(?:must|shall|only|before|until|unless|required|requires|allowed|permitted|prohibited|cannot)\b|\b(?:may|can|do)\s+not\b"
BLOCKS = {
    "zh": [("lead", "规则与适用范围"), ("step", "操作步骤"), ("record", "记录与用途"), ("limit", "条件与边界")],
    "en": [("lead", "Rules and scope"), ("step", "Procedure"), ("record", "Records and purposes"), ("limit", "Conditions and boundaries")],
}


def by_facet(found: DataFrame, final_k: int) -> DataFrame:
    """found (qid, facet, id, key, score), one search a facet -> qid, id, key, rank, place: covers of the facets first.

    A document that several facets found counts once, with its best score and all of them. Empty input gives no rows.
    """
    each = found.groupBy("qid", "id", "key").agg(F.max("score").alias("score"), F.collect_set("facet").alias("matched"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return selected(each.withColumn("rank", F.row_number().over(order)), final_k)


def augmented(channels: DataFrame, keys: DataFrame, final_k: int) -> DataFrame:
    """channels (qid, channel, weight, id, rank) and keys (id, key) -> qid, id, key, rank, place.

    A channel counts for the queries it has rows for; the fused ones are cut to the first of each key.
    """
    fused = weighted_rrf(channels.withColumnRenamed("id", "key")).withColumnRenamed("key", "id")
    named = fused.join(keys, "id").withColumn("matched", F.array().cast("array<string>"))
    return selected(named, final_k)


def with_second_pass(first: DataFrame, states: DataFrame, second: DataFrame) -> DataFrame:
    """Rows (qid, ...) of the first pass for queries whose state is accept, else those of the second; ``retried`` tells which."""
    accepted = states.where("state = 'accept'").select("qid")
    kept = first.join(accepted, "qid", "left_semi").withColumn("retried", F.lit(False))
    return kept.unionByName(second.join(accepted, "qid", "left_anti").withColumn("retried", F.lit(True)))


def without_rerank(hits: DataFrame, k: int, error: str | None = None) -> DataFrame:
    """hits (qid, id, rank) -> the first k of a query as they were, marked as not reranked and with the reason."""
    return hits.where(F.col("rank") <= k).withColumn("rerank_applied", F.lit(False)).withColumn("rerank_error", F.lit(error).cast("string"))


def ranked_chunks(ranks: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """ranks (id, rank) and chunks (id, source, ordinal, text) -> the k first chunks by rank, id and ordinal.

    Equal texts of one source count once, at their best place; chunks without text never.
    """
    # The join moves digests, not texts.
    told = chunks.where(F.length("text") > 0).select("id", "source", "ordinal", F.sha2("text", 256).alias("digest"))
    met = told.join(ranks.select("id", "rank"), "id")
    at = F.struct((-F.col("rank")).alias("back"), F.col("id"), F.col("ordinal"))
    first = met.groupBy("source", "digest").agg(F.min(at).alias("at"))
    rows = first.select("source", F.col("at.id").alias("id"), F.col("at.ordinal").alias("ordinal"), (-F.col("at.back")).alias("rank"))
    return rows.orderBy(F.desc("rank"), "id", "ordinal").limit(k)


def token_matched(pages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """pages (page, tokens) and queries (qid, tokens), unit vectors: mean over a query's tokens of the best page token.

    Callers bound the tokens of a page and of a query. Queries go out in blocks; a query without tokens has no rows.
    """
    asked = queries.where(F.size("tokens") > 0)
    blocks = max(1, -(-asked.count() // (BLOCK // 16)))
    scored = None
    for n in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n)
        block = part.agg(F.collect_list(F.struct("qid", F.col("tokens").alias("q"))).alias("block"))
        met = pages.where(F.size("tokens") > 0).crossJoin(F.broadcast(block)).select("page", "tokens", F.inline("block"))
        best = F.transform("q", lambda x: F.array_max(F.transform("tokens", lambda y: dot(x, y))))
        mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size("q")
        some = met.select("qid", "page", F.round(mean, 6).alias("score"))
        scored = some if scored is None else scored.unionByName(some)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "page")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def valid_pages(pages: DataFrame, by: str, page: str, held: Column, stated: Column) -> DataFrame:
    """by, valid: the pages of a generation follow one another without gap or repeat, and each has the hash stated for it."""
    sums = pages.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(page).alias("distinct"), (F.max(page) - F.min(page) + 1).alias("span"), F.bool_and(F.coalesce(held == stated, F.lit(False))).alias("same")
    )
    return sums.select(by, ((F.col("n") == F.col("span")) & (F.col("distinct") == F.col("n")) & F.col("same")).alias("valid"))


def corpus_ids(found: DataFrame, corpus: DataFrame, known: str, normal: str, fallback: Column) -> DataFrame:
    """found with ``id``: the known one, else that of the corpus text (id, normal) equal after normalising, else the fallback.

    Of equal corpus texts the smallest id counts; the join is on a digest, so no text is shuffled twice.
    """
    texts = corpus.groupBy(F.sha2(normal, 256).alias("__digest")).agg(F.min("id").cast("string").alias("__id"))
    met = found.withColumn("__digest", F.sha2(normal, 256)).join(texts, "__digest", "left")
    return met.withColumn("id", F.coalesce(F.nullif(F.col(known).cast("string"), F.lit("")), "__id", fallback)).drop("__digest", "__id")


def procedure_blocks(units: DataFrame, by: str, lang: str = "en") -> DataFrame:
    """units (by, clause, source, body, role) -> by, place, block: a titled paragraph a role, with its sources once each.

    Main rules and scope lead; a step that states a condition joins them. Without any lead there is no procedure and no rows.
    """
    role = F.when(F.col("role").isin("main_rule", "scope"), "lead").when((F.col("role") == "step") & F.col("body").rlike(CONSTRAINT), "lead").otherwise(F.col("role"))
    rows = units.withColumn("role", role)
    rows = rows.withColumn("__lead", F.max((F.col("role") == "lead").cast("int")).over(Window.partitionBy(by))).where("__lead = 1")
    held = rows.groupBy(by, "role").agg(F.array_sort(F.collect_list(F.struct("clause", "body", "source"))).alias("x"))
    place = F.lit(None).cast("int")
    title = F.lit(None).cast("string")
    for n, (name, words) in enumerate(BLOCKS[lang], 1):
        place = F.when(F.col("role") == name, n).otherwise(place)
        title = F.when(F.col("role") == name, words).otherwise(title)
    names = F.array_distinct(F.transform("x", lambda x: x["source"]))
    cited = F.array_join(F.transform(names, lambda s: F.concat(F.lit("["), s, F.lit("]"))), "")
    block = F.concat(F.lit("**"), title, F.lit("**\n\n"), F.array_join(F.transform("x", lambda x: x["body"]), " "), cited)
    return held.select(by, place.alias("place"), block.alias("block")).where("place is not null")


def with_roles(units: DataFrame, roles: DataFrame, by: str) -> DataFrame:
    """units (by, clause, source, body) and roles (by, clause, role) a reply gave -> units with their role, of those whose clauses are just the ones named.

    A clause without a role, a role of an unknown clause or of none leaves the whole procedure out. Clauses are single in each.
    """
    keys = [by, "clause"]
    both = units.withColumn("__unit", F.lit(True)).join(roles.select(*keys, "role"), keys, "full")
    whole = both.groupBy(by).agg(F.bool_and(F.coalesce("__unit", F.lit(False)) & F.col("role").isNotNull()).alias("__whole")).where("__whole")
    return both.drop("__unit").join(whole.drop("__whole"), by, "left_semi")


@F.pandas_udf(SPANS)
def piece_spans(text: pd.Series, pieces: pd.Series) -> pd.Series:
    """Where the pieces stand in the text, each looked for after the one before; null if one is not there or the text is null.

    A search that goes on from the last end is linear in the text; column functions count from its begin each time.
    """

    def spans(whole, parts):
        if whole is None or parts is None:
            return None
        at, out = 0, []
        for part in parts:
            begin = whole.find(part, at) if part else at
            if begin < 0:
                return None
            at = begin + len(part or "")
            out.append({"begin": begin, "end": at})
        return out

    return pd.Series([spans(w, p) for w, p in zip(text, pieces)], dtype=object)
