"""A training corpus from ``documents``: five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from querywell.llm.common import shared_folder, table
from querywell.llm.decontaminate import drop_contaminated
from querywell.llm.language_id import drop_unidentified
from querywell.llm.mixing import mixed
from querywell.llm.pii import redacted
from querywell.llm.simhash import drop_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_unidentified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Language profiles, SimHash components and the span classifier are not SQL's; a brute-force version tests each stage.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again.

    A stage's folder goes once the next one is written; the last one is read by the result and stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
