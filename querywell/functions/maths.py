"""Numeric functions over columns. Unavailable is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS, LEAST_DECAY = 180.0, 0.1
#: Ranks of authorities and statuses.
AUTHORITY = {"official": 5, "regulatory": 5, "approved": 4, "internal": 3, "draft": 1}
STATUS = {"obsolete": 0, "retired": 0, "draft": 1}


def finite(x: Column) -> Column:
    value = x.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def probability(x: Column) -> Column:
    return F.when(finite(x).between(0, 1), finite(x))


def decay_factor(age_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    return F.when(age_days <= 0, 1.0).otherwise(F.greatest(F.lit(LEAST_DECAY), F.least(F.lit(1.0), F.pow(F.lit(0.5), age_days / half_life))))


def fused_relevance(rerank: Column, llm: Column, embedding: Column) -> Column:
    """.5 rerank, .4 grade, .1 embedding, renormalised over those that are present."""
    parts = [(rerank, 0.5), (llm, 0.4), (embedding, 0.1)]
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    return F.when(weight > 0, sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0)) / weight)


def answer_confidence(retrieval: Column, grounding: Column, intent: Column) -> Column:
    """.4/.4/.2; a missing grounding gives its weight to retrieval first."""
    w_retrieval = F.when(grounding.isNull(), 0.8).otherwise(0.4)
    total = F.when(retrieval.isNotNull(), w_retrieval).otherwise(0.0) + F.when(grounding.isNotNull(), 0.4).otherwise(0.0) + F.when(intent.isNotNull(), 0.2).otherwise(0.0)
    value = F.coalesce(retrieval * w_retrieval, F.lit(0.0)) + F.coalesce(grounding * 0.4, F.lit(0.0)) + F.coalesce(intent * 0.2, F.lit(0.0))
    return F.when(total > 0, value / total)


def confidence_level(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x >= 0.8, "high").when(x >= 0.5, "medium").otherwise("low")


def composite_score(rule: Column, faith: Column, relevancy: Column, context: Column, hallucination: Column) -> Column:
    base = rule * 0.3 + faith * 0.4 + relevancy * 0.15 + context * 0.15
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * (1 - 0.5 * hallucination)))


def authority_value(x: Column) -> Column:
    named = F.lit(0.0)
    for name, rank in AUTHORITY.items():
        named = F.when(F.lower(x) == name, float(rank)).otherwise(named)
    return F.coalesce(finite(x), named)


def status_rank(x: Column) -> Column:
    out = F.lit(2)
    for name, rank in STATUS.items():
        out = F.when(F.lower(F.trim(x)) == name, rank).otherwise(out)
    return out


def revision_digits(x: Column) -> Column:
    return F.coalesce(F.regexp_replace(x, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def cost(tokens: Column, price_per_million: Column) -> Column:
    return F.coalesce(tokens / 1e6 * price_per_million, F.lit(0.0))
