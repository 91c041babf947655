"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rules: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a new folder in a local session that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return shared or tempfile.mkdtemp(prefix="spark-checkpoints-")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a local session
    that names none (a test) gets a folder of its own; on a cluster none is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with, of each name, the sum of a column over all rows before in the given order (0 for the first).

    Rows are sorted into ranges over the tasks; each range sums its rows, the few
    sums give each range its offset, a window within the range does the rest.
    """
    ranged = durable(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("range_number")))
    ranges = ranged.groupBy(F.col("range_number").alias("number")).agg(*(F.sum(c).alias(f"{n}_of_range") for n, c in sums.items()))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    offsets = ranges.select("number", *(F.coalesce(F.sum(f"{n}_of_range").over(before), F.lit(0)).alias(f"{n}_offset") for n in sums))
    within = Window.partitionBy("range_number").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{n}_within") for n, c in sums.items()))
    placed = placed.join(F.broadcast(offsets), placed["range_number"] == offsets["number"])
    return placed.select(*rows.columns, *((F.col(f"{n}_offset") + F.col(f"{n}_within")).alias(n) for n in sums))


def once(rows: DataFrame, columns: list[str], **found: Column) -> DataFrame:
    """These columns and found, computed behind a generator, so that the optimizer does not copy their expressions to each of their uses."""
    return rows.select(*columns, F.inline(F.array(F.struct(*(c.alias(name) for name, c in found.items())))))


@cache
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name)) if "/" not in name else name


def min_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links i-j."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[i], labels[j])
        new = labels.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, labels[i], low)
        np.minimum.at(new, labels[j], low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``key``, cut so that no group lies in two of them."""
    rest = None
    for batch in batches:
        if rest is not None and len(rest):
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
        rest = batch.iloc[cut:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).collect()


def drawn_if(rows: DataFrame, most: int, *columns: str) -> Column:
    """Whether a row is one of about ``most`` at most: those whose hash of the columns is small, the same ones in every run."""
    share = min(1.0, most / max(1, rows.count()))
    return F.pmod(F.xxhash64(F.lit("drawn"), *columns), F.lit(1 << 30)) < int(share * (1 << 30))


def drawn(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """About ``most`` rows at most, drawn by hash, from every task a few."""
    return rows.where(drawn_if(rows, most, *columns))
