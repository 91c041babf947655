"""Incremental operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATENESS = "10 minutes"


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Counts and means by kind and window; late rows beyond the watermark are not counted."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def captured(events: DataFrame, rate: float = 0.1, key: str = "event_id") -> DataFrame:
    """Always errors, and a share of the rest by hash of the id, once each."""
    draw = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("double") / float(16**7)
    return events.where((F.col("event_type") == "error") | (draw < max(rate, 0.05)))


def touched_sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    return events.withWatermark(at, lateness).groupBy(F.session_window(at, gap), user).agg(F.count(F.lit(1)).alias("n"))


def circuit_breaker(calls: DataFrame, threshold: int = 5, successes: int = 2, wait_seconds: float = 30.0) -> DataFrame:
    """calls (service, at double, ok boolean) -> each change of a service's state: closed, open, half_open.

    The state between batches is the mode, failures in a row, successes in a row
    and when it opened; a batch of one service is read in order of ``at``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, failures, good, opened = state.get if state.exists else ("closed", 0, 0, 0.0)
        changes = []
        for batch in batches:
            for at, ok in batch.sort_values("at")[["at", "ok"]].itertuples(index=False):
                before = mode
                if mode == "open" and at - opened >= wait_seconds:
                    mode, good = "half_open", 0
                    changes.append((key[0], float(at), before, mode))
                    before = mode
                if mode == "open":
                    continue
                failures, good = (0, good + 1) if ok else (failures + 1, 0)
                if not ok and (mode == "half_open" or failures >= threshold):
                    mode, opened = "open", float(at)
                elif mode == "half_open" and good >= successes:
                    mode, failures = "closed", 0
                if mode != before:
                    changes.append((key[0], float(at), before, mode))
        state.update((mode, int(failures), int(good), float(opened)))
        yield pd.DataFrame(changes, columns=["service", "at", "before", "after"])

    return calls.groupBy("service").applyInPandasWithState(step, "service string, at double, before string, after string", "mode string, failures long, good long, opened double", "append", GroupStateTimeout.NoTimeout)


def upserted(rows: DataFrame, path: str, key: str = "id", order: str = "at", parts: int = 64):
    """A sink that keeps the last row of each key, in ``parts`` parts by hash of the key.

    A batch writes new versions of the parts that it touches, each under a name of
    its own attempt, and then adds them to the pointer table. A batch that the
    pointer already holds is skipped, so a replay changes nothing; an attempt that
    fails before the pointer leaves only files that nobody reads.
    """
    import uuid

    from ..operators.generations import latest

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        pointer = current_parts(spark, path)
        if any(r["batch"] >= n for r in pointer):
            return
        own = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)))
        touched = [r["part"] for r in own.select("part").distinct().collect()]  # at most ``parts``
        folders = [r["folder"] for r in pointer if r["part"] in touched]
        every = own
        if folders:
            every = every.unionByName(spark.read.parquet(*folders).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts))))
        attempt = f"{path}/batch={n}-{uuid.uuid4().hex}"
        latest(every, key, order).write.partitionBy("part").parquet(attempt)
        moved = [(n, p, f"{attempt}/part={p}") for p in touched]
        if moved:
            spark.createDataFrame(moved, "batch long, part long, folder string").coalesce(1).write.mode("append").parquet(f"{path}/pointer")

    return rows.writeStream.foreachBatch(write)


def current_parts(spark, path: str) -> list:
    """The newest (batch, part, folder) of each part of an upserted table; none before the first batch."""
    from pyspark.errors import AnalysisException

    try:
        pointer = spark.read.schema("batch long, part long, folder string").parquet(f"{path}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return pointer.groupBy("part").agg(F.max_by(F.struct("batch", "folder"), "batch").alias("x")).select("x.batch", "part", "x.folder").collect()


def upserted_rows(spark, path: str) -> DataFrame:
    """What an upserted table holds now."""
    return spark.read.parquet(*(r["folder"] for r in current_parts(spark, path)))
