"""Retrieval metrics, roll-ups and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import quantiles, skyline

#: A drop of a metric beyond this is a regression; the gates' limits.
REGRESSION, GATE_DROP, PARETO_LOSS, PARETO_SLOWDOWN = 0.05, 0.02, 0.02, 1.25


def context_precision_recall(expected: Column, found: Column) -> tuple[Column, Column]:
    """On sets: hits / found and hits / expected; null without expected ids, precision null if nothing was found."""
    e, f = F.array_distinct(expected), F.array_distinct(found)
    hits = F.size(F.array_intersect(e, f))
    known = F.size(e) > 0
    return F.when(known & (F.size(f) > 0), hits / F.size(f)), F.when(known, F.when(F.size(f) > 0, hits / F.size(e)).otherwise(0.0))


def ranked_metrics(run: DataFrame, qrels: DataFrame, k: int = 10, deep: int = 100) -> DataFrame:
    """run (qid, doc_id, rank) and qrels (qid, doc_id, grade) -> qid, ndcg, rr, recall; linear gain, over all judged queries."""
    grades = qrels.groupBy("qid", "doc_id").agg(F.max("grade").alias("grade"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc_id"))
    ideal = grades.where("grade > 0").withColumn("place", place).groupBy("qid").agg(F.sum(F.when(F.col("place") <= k, F.col("grade") / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal"), F.count(F.lit(1)).alias("relevant"))
    hits = run.join(grades.where("grade > 0"), ["qid", "doc_id"])
    got = hits.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= deep, 1).otherwise(0)).alias("deep")
    )
    joined = ideal.join(got, "qid", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return joined.select("qid", zero(F.col("dcg") / F.col("ideal")).alias("ndcg"), zero(1 / F.col("first")).alias("rr"), zero(F.col("deep") / F.col("relevant")).alias("recall"))


def report(scores: DataFrame, by: str, threshold: float = 0.7) -> DataFrame:
    """scores (by, score, error) -> total, passed (score reaches the threshold, no error), failed, average over known scores."""
    ok = (F.col("score") >= threshold) & ~F.col("error")
    out = scores.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("passed"), F.round(F.avg("score"), 6).alias("average"))
    return out.withColumn("failed", F.col("total") - F.col("passed"))


def compared(old: DataFrame, new: DataFrame, key: str, metric: str, higher_is_better: bool = True, limit: float = REGRESSION) -> DataFrame:
    """Delta of a metric by key, and whether it is worse by more than the limit; null if either is missing."""
    joined = old.select(key, F.col(metric).alias("old")).join(new.select(key, F.col(metric).alias("new")), key, "full")
    delta = F.col("new") - F.col("old")
    return joined.select(key, F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), F.round(delta, 6).alias("delta"), ((-delta if higher_is_better else delta) > limit).alias("regressed"))


def medians(runs: DataFrame, *by: str, metric: str) -> DataFrame:
    """by, median and least of a metric, and how many runs have it; a group without any has nulls and 0."""
    found = quantiles(runs, list(by), metric, {"worst": 0.0}, {"median": 0.5}).select(*(F.col(c).alias(f"__{c}") for c in by), "n", "median", "worst")
    every = runs.select(*by).distinct()
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = every.join(found, same, "left")
    return joined.select(*by, F.round("median", 6).alias("median"), F.round("worst", 6).alias("worst"), F.coalesce("n", F.lit(0)).alias("runs"))


def reference_delta(variants: DataFrame, dataset: str, variant: str, metric: str, reference: str) -> DataFrame:
    base = variants.where(F.col(variant) == reference).select(dataset, F.col(metric).alias("base"))
    joined = variants.where(F.col(variant) != reference).join(base, dataset)
    return joined.select(dataset, variant, F.round(F.col(metric) - F.col("base"), 6).alias("delta"), F.round(F.try_divide(F.col(metric) - F.col("base"), F.col("base")), 6).alias("relative"))


def pareto(rows: DataFrame, key: str, quality: str, price: str) -> DataFrame:
    """Rows that no other beats: sorted by price, those whose quality exceeds all cheaper ones'. Rows without a price are left out."""
    return skyline(rows, quality, price).select(key, quality, price)


def drift(runs: DataFrame, group: str, position: str, value: str, limit: float = 0.25) -> DataFrame:
    each = quantiles(runs, [group, position], value, {"p95": 0.95})
    out = each.groupBy(group).agg(F.round(F.min("p95"), 6).alias("least"), F.round(F.max("p95"), 6).alias("most"), F.round(F.median("p95"), 6).alias("middle"))
    return out.withColumn("warning", (F.col("most") - F.col("least")) / F.col("least") > limit)


def promotion_gate(variants: DataFrame, key: str, quality: str, latency: str, base: DataFrame) -> DataFrame:
    """Whether a variant loses at most PARETO_LOSS of quality and slows down at most PARETO_SLOWDOWN times against the base of each key."""
    joined = variants.join(base.select(key, F.col(quality).alias("__q"), F.col(latency).alias("__l")), key)
    return joined.withColumn("promoted", (F.col("__q") - F.col(quality) <= PARETO_LOSS) & (F.col(latency) <= PARETO_SLOWDOWN * F.col("__l"))).drop("__q", "__l")


def order_independent(runs: DataFrame, by: str, order: str, metric: str, limit: float = 1e-9) -> DataFrame:
    """Whether a metric's mean is the same in all orders, of which there must be two or more."""
    each = runs.groupBy(by, order).agg(F.avg(metric).alias("m"))
    return each.groupBy(by).agg(F.count(F.lit(1)).alias("orders"), F.round(F.max("m") - F.min("m"), 6).alias("spread")).withColumn("independent", (F.col("orders") >= 2) & (F.col("spread") <= limit))


def rank_aware_precision(relevant: Column) -> Column:
    """Sum of 1/k over the places k of relevant results, divided by their number; null without any."""
    places = F.filter(F.transform(relevant, lambda r, k: F.when(r, 1 / (k + 1))), lambda x: x.isNotNull())
    return F.when(F.size(places) > 0, F.aggregate(places, F.lit(0.0), lambda s, v: s + v) / F.size(places))


def supported_share(supported: Column) -> Column:
    """Of verdicts true, false or null (not judged): the share of true ones in the judged ones; null if none was."""
    judged = F.filter(supported, lambda x: x.isNotNull())
    return F.when(F.size(judged) > 0, F.size(F.filter(judged, lambda x: x)) / F.size(judged))


def char_overlap(reference: Column, top: Column) -> Column:
    """Share of the reference's characters that the top chunk holds."""
    chars = F.split(reference, "")
    return F.when(F.length(reference) == 0, 0.0).otherwise(F.size(F.filter(chars, lambda c: top.contains(c))) / F.length(reference))


def binary_ranked(expected: Column, retrieved: Column) -> tuple[Column, Column]:
    """Reciprocal rank and nDCG of 0/1 relevance; the ideal has no more hits than were retrieved. Null without expected ids."""
    known = F.size(F.array_distinct(expected))
    gain = lambda r: F.lit(1.0) / F.log2(r + F.lit(1.0))
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda r: r.isNotNull())
    total = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda s, r: s + gain(r))
    hits = F.least(known, F.size(retrieved))
    ideal = total(F.sequence(F.lit(1), F.greatest(hits, F.lit(1))))
    rr = F.coalesce(F.lit(1.0) / F.array_min(places), F.lit(0.0))
    return F.when(known > 0, rr), F.when(known > 0, F.when(hits > 0, total(places) / ideal).otherwise(0.0))


def run_records(runs: DataFrame) -> DataFrame:
    """(qid, doc_ids, scores) -> qid, doc_id, score: the first place of each document; without a score its distance from the end."""
    each = runs.select("qid", F.size("doc_ids").alias("n"), "scores", F.posexplode("doc_ids").alias("at", "doc_id"))
    scored = each.withColumn("score", F.coalesce(F.get("scores", F.col("at")).cast("double"), (F.col("n") - F.col("at")).cast("double")))
    first = scored.groupBy("qid", "doc_id").agg(F.min_by("score", "at").alias("score"))
    return first.select("qid", "doc_id", "score")


def facet_coverage(facets: Column, uncovered: Column) -> Column:
    return F.when(facets > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (facets - F.coalesce(uncovered, F.lit(0))) / facets)))


def not_comparable(checks: dict[str, Column]) -> Column:
    """Names of the checks of a run that fail, in order; a check that can't be made fails."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items())), lambda x: x.isNotNull())


def protocol_checks(split: str, depth: int) -> dict[str, Column]:
    """The checks that make a run on a public dataset an official one, over the columns of its manifest."""
    c = F.col
    return {
        "sampled_corpus": c("corpus_mode") == "full",
        "query_limit_applied": c("query_limit").isNull(),
        "doc_limit_applied": c("doc_limit").isNull(),
        "corpus_deduplicated": ~c("deduplicated"),
        "nonstandard_split": c("split") == split,
        "incomplete_query_set": c("selected_query_count").eqNullSafe(c("source_query_count")),
        "wrong_run_protocol": c("benchmark_protocol") == "public_quality",
        "evaluation_depth_too_small": (c("evaluation_depth") >= depth) & (c("top_k") >= depth),
        "retrieval_depth_too_small": c("leg_depth") >= depth,
    }


def baseline_gate(current: Column, base: Column, drop: float = GATE_DROP) -> Column:
    """Whether a metric holds its baseline; one that is missing or not within 0 and 1 fails."""
    return F.coalesce(current.between(0, 1) & ~F.isnan(current) & ~F.isnan(base) & (current >= base - drop), F.lit(False))


def order_pairs(runs: DataFrame, by: str, order: str, metric: str, limit: float = 1e-9) -> DataFrame:
    """AB against BA: both orders must be there and their means alike."""
    mean = lambda o: F.avg(F.when(F.col(order) == o, F.col(metric)))
    both = runs.groupBy(by).agg(mean("AB").alias("ab"), mean("BA").alias("ba"))
    return both.select(by, F.round(F.col("ab") - F.col("ba"), 6).alias("delta"), F.coalesce(F.abs(F.col("ab") - F.col("ba")) <= limit, F.lit(False)).alias("independent"))


def unavailable(rows: DataFrame, status: str) -> DataFrame:
    """(status map) -> channel, n: how often a channel was asked and gave nothing."""
    each = rows.select(F.explode(status).alias("channel", "state")).where("state = 'unavailable_or_no_match'")
    return each.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


def channel_status(asked: Column, gave: Column) -> Column:
    return F.when(~asked, "disabled").when(gave, "contributed").otherwise("unavailable_or_no_match")


def balanced_schedule(variants: DataFrame, name: str) -> DataFrame:
    """A configuration's few variants -> round, position, name: cyclic rotations, so that each stands once in every position."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    placed = variants.select(name, (F.row_number().over(Window.orderBy(name)) - 1).alias("k"), n.alias("n"))
    rounds = placed.select(name, "k", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("round"))
    return rounds.select("round", F.pmod(F.col("k") - F.col("round"), F.col("n")).cast("int").alias("position"), name)


def grid(rows: DataFrame, **values: list) -> DataFrame:
    """Each row once for every combination of the parameters' values."""
    for name, some in values.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, some))))
    return rows


def answer_relevancy(cosine: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine + 1) / 2))


def first_failure(checks: dict[str, Column]) -> Column:
    """Name of the first check that does not hold, null if all do; one that can't be made fails."""
    return F.get(not_comparable(checks), F.lit(0))


def coverage(text: Column, expected: Column) -> Column:
    """Share of the expected strings in the text; 1 where none are."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.filter(expected, lambda k: text.contains(k))) / F.size(expected))
