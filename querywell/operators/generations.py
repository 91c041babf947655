"""Versions of derived tables: publish, collect garbage, replace by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(generations: DataFrame) -> DataFrame:
    """generations (id, source, status, at) -> the newest ready one of each source; a failed publish leaves the one before."""
    order = Window.partitionBy("source").orderBy(F.desc("at"), F.desc("id"))
    return generations.where("status = 'ready'").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def garbage(generations: DataFrame, cutoff: Column) -> DataFrame:
    """Generations older than the cutoff that are not active."""
    return generations.where(F.col("at") < cutoff).join(active(generations).select("id"), "id", "left_anti")


def replaced(old: DataFrame, new: DataFrame, by: str = "source") -> DataFrame:
    """old without the sources that new brings, and new."""
    return old.join(new.select(by).distinct(), by, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Last wins: one row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("__n", place).where("__n = 1").drop("__n")


def merged_entities(entities: DataFrame) -> DataFrame:
    """entities (id, source, description, at) -> one row of each id and source: mentions, last description that is not empty."""
    text = F.when(F.col("description") != "", F.col("description"))
    return entities.groupBy("id", "source").agg(F.count(F.lit(1)).alias("mentions"), F.max_by(text, F.when(text.isNotNull(), F.col("at"))).alias("description"))


def missing(indexed: DataFrame, stored: DataFrame, key: str = "source") -> DataFrame:
    return indexed.select(key).distinct().join(stored.select(key), key, "left_anti")


def hash_sample(rows: DataFrame, key: str, n: int, seed: str = "seed") -> DataFrame:
    """The n rows with the smallest sha256 of seed:key."""
    return rows.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).orderBy("__h").limit(n).drop("__h")


def recovered(jobs: DataFrame, status: str, since: str, now: Column, seconds: int = 120) -> DataFrame:
    """Jobs that have been processing for longer than the limit are failed."""
    stale = (F.col(status) == "processing") & (F.col(since) < now - F.make_dt_interval(secs=F.lit(seconds)))
    return jobs.withColumn(status, F.when(stale, "failed").otherwise(F.col(status)))
