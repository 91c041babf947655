"""Scoring logged answers from what a judge said of them: one plan from records and verdicts to the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import without_boilerplate
from ..functions.maths import composite_score
from ..functions.text import claims
from .guard import hard_claim

#: Fixed value: the score from which a record has passed.
PASSED = 0.6


def claim_rows(records: DataFrame) -> DataFrame:
    """(id, answer, reference_answer, contexts) -> id, part (answer or reference), ordinal from 0, claim, hard: what a judge is to be asked.

    Guardrail notes are taken off the answer first. Records without any context that is not blank have none; an answer's
    claim is hard if it holds a value, a step or a conclusion.
    """
    held = records.where(F.exists(F.coalesce("contexts", F.array().cast("array<string>")), lambda c: F.trim(c) != ""))
    parts = [held.select("id", F.lit(part).alias("part"), F.posexplode(claims(text)).alias("ordinal", "claim")) for part, text in (("answer", without_boilerplate(F.coalesce("answer", F.lit("")), [])), ("reference", F.coalesce("reference_answer", F.lit(""))))]
    return parts[0].unionByName(parts[1]).withColumn("hard", (F.col("part") == "answer") & hard_claim(F.col("claim")))


def _share(part: Column, verdict: Column) -> Column:
    """Of the verdicts on a part that are not null, the share of true ones; null if none is."""
    return F.try_divide(F.count_if(part & verdict), F.count(F.when(part, verdict)))


def judged(claims_of: DataFrame, verdicts: DataFrame, relevant: DataFrame) -> DataFrame:
    """claim_rows, verdicts (id, part, ordinal, supported) and relevant (id, place from 1, relevant) -> id, faithfulness, hallucination_score, context_recall, context_precision.

    Faithfulness and recall are the supported shares of an answer's and a reference's claims, hallucination the unsupported one of the
    hard claims, 0 of none; precision is the mean of 1/place over relevant contexts. A claim that was not judged counts nowhere; a metric without a judged one is null.
    """
    asked = claims_of.join(verdicts, ["id", "part", "ordinal"], "left")
    of = lambda part: F.col("part") == part
    unsupported = F.try_divide(F.count_if(F.col("hard") & ~F.col("supported")), F.count(F.when(F.col("hard"), F.col("supported"))))
    shares = asked.groupBy("id").agg(
        _share(of("answer"), F.col("supported")).alias("faithfulness"), _share(of("reference"), F.col("supported")).alias("context_recall"),
        F.when(F.count_if(of("answer")) > 0, F.when(F.count_if("hard") == 0, 0.0).otherwise(unsupported)).alias("hallucination_score"),
    )
    ranks = relevant.groupBy("id").agg(F.avg(F.when(F.col("relevant"), 1 / F.col("place"))).alias("context_precision"))
    return shares.join(ranks, "id", "full")


def scored(records: DataFrame, metrics: DataFrame, rule: Column | None = None) -> DataFrame:
    """records (id, intent, source_count, contexts, answer_relevancy) and ``judged`` metrics -> each record with its metrics and overall_score.

    The rule's part is 1 for a replayed record. Without faithfulness it is the whole score; what else is null counts as the rule's part,
    hallucination as none. A record that gives no source_count has as many as contexts.
    """
    rows = records.join(metrics, "id", "left")
    base = F.lit(1.0) if rule is None else rule
    context = F.coalesce((F.col("context_precision") + F.col("context_recall")) / 2, "context_precision", "context_recall", base)
    blended = composite_score(base, F.col("faithfulness"), F.coalesce("answer_relevancy", base), context, F.coalesce("hallucination_score", F.lit(0.0)))
    overall = F.when(F.col("faithfulness").isNotNull(), blended).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))
    return rows.withColumn("source_count", F.coalesce("source_count", F.size(F.coalesce("contexts", F.array().cast("array<string>"))))).withColumn("overall_score", overall)


def replay_report(scores: DataFrame, *by: str, threshold: float = PASSED) -> DataFrame:
    """``scored`` rows -> by, total, passed, failed and the mean of each metric over the records that have it."""
    names = ("overall_score", "faithfulness", "answer_relevancy", "hallucination_score", "context_precision", "context_recall")
    passed = F.count_if(F.col("overall_score") >= threshold)
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), passed.alias("passed"), (F.count(F.lit(1)) - passed).alias("failed"), *(F.avg(n).alias(f"avg_{n}") for n in names))
