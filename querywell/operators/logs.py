"""Analytics over request, feedback and session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import quantiles


def latency_summary(log: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The first request of each group (all that share its place) is cold and left out; p50 is the median, p95 the nearest rank."""
    first = log.groupBy(F.col(by).alias("__by")).agg(F.min(order).alias("__first"))
    warm = log.join(first, F.col(by).eqNullSafe(F.col("__by"))).where(F.col(order) > F.col("__first"))
    found = quantiles(warm, [by], value, {"p95": 0.95}, {"p50": 0.5})
    counts = warm.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("all"))
    joined = counts.join(found, F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.select(F.col("__by").alias(by), F.col("all").alias("n"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def rates(log: DataFrame, kind: str, positive: str) -> DataFrame:
    """Count of each kind, and the share of the positive one in all."""
    share = F.sum(F.sum(F.when(F.col(kind) == positive, 1).otherwise(0))).over(Window.partitionBy()) / F.sum(F.count(F.lit(1))).over(Window.partitionBy())
    return log.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("positive_rate"))


def sessions(log: DataFrame, user: str, at: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions cut at gaps: user, session (from 1), begin, end and number of events."""
    order = Window.partitionBy(user).orderBy(at)
    new = F.when(F.col(at) > F.lag(at).over(order) + F.expr(f"interval {gap_minutes} minutes"), 1).when(F.lag(at).over(order).isNull(), 1).otherwise(0)
    marked = log.select(user, at).withColumn("__new", new)
    numbered = marked.withColumn("session", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "session").agg(F.min(at).alias("begin"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"))


def history_split(messages: DataFrame, most: int = 10, keep: int = 6) -> DataFrame:
    """conversations (conv_id, turn, ...) -> each message as old (to summarise) or recent; short ones are all recent."""
    every = Window.partitionBy("conv_id")
    back = F.row_number().over(every.orderBy(F.desc("turn")))
    n = F.count(F.lit(1)).over(every)
    return messages.withColumn("part", F.when((n > most) & (back > keep), "old").otherwise("recent"))


def sampled(log: DataFrame, key: Column, always: Column, rate: float, floor: float = 0.05) -> DataFrame:
    """Rows with an always-capture signal, and a fixed share of the rest by hash of the key."""
    draw = F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("double") / float(16**7)
    return log.where(F.coalesce(always, F.lit(False)) | (F.lit(rate) > 0) & (draw < max(rate, floor)))


def circuit_states(calls: DataFrame, group: str, order: str, failed: Column, threshold: int = 5) -> DataFrame:
    """Runs of failures: where the circuit of each group opens (the threshold-th failure in a row)."""
    each = Window.partitionBy(group).orderBy(order)
    marked = calls.withColumn("__f", failed.cast("int")).withColumn("__run", F.sum(1 - F.col("__f")).over(each))
    return marked.where("__f = 1").withColumn("failures", F.row_number().over(Window.partitionBy(group, "__run").orderBy(order))).where(F.col("failures") == threshold).select(group, order, "failures")


def load_report(log: DataFrame, by: str, at: str, latency: str) -> DataFrame:
    """Requests, requests a second from the first to the last, mean latency and its nearest-rank percentiles."""
    seconds = (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / 1e6
    n = F.count(F.lit(1))
    whole = log.groupBy(F.col(by).alias("__by")).agg(n.alias("all"), F.round(F.try_divide(n, seconds), 6).alias("per_second"), F.round(F.avg(latency), 6).alias("mean"))
    found = quantiles(log, [by], latency, {f"p{p}": p / 100 for p in (50, 95, 99)})
    joined = whole.join(found, F.col("__by").eqNullSafe(F.col(by)), "left")
    return joined.select(F.col("__by").alias(by), F.col("all").alias("n"), "per_second", "mean", "p50", "p95", "p99")


def joined_feedback(feedback: DataFrame, inferences: DataFrame) -> DataFrame:
    """feedback (id, trace_id, message_id) and inferences (inference_id, trace_id, message_id) -> id, inference_id: by trace, else by message; null if neither is known."""

    def keyed(rows: DataFrame, *keep: str) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(n).alias("by"), F.col(c).cast("string").alias("key")) for n, c in enumerate(("trace_id", "message_id"))))
        return rows.select(*keep, F.inline(keys)).where("key is not null")

    found = keyed(feedback, "id").join(keyed(inferences, "inference_id"), ["by", "key"])
    best = found.groupBy("id").agg(F.min(F.struct("by", "inference_id"))["inference_id"].alias("inference_id"))
    return feedback.select("id").join(best, "id", "left")
