"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a new folder in a local session that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return shared or tempfile.mkdtemp(prefix="spark-checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def once(rows: DataFrame, columns: list[str], **found: Column) -> DataFrame:
    """These columns and found, computed behind a generator, so that the optimizer does not copy their expressions to each of their uses."""
    return rows.select(*columns, F.inline(F.array(F.struct(*(c.alias(name) for name, c in found.items())))))
