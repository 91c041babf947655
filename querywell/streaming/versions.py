"""Tables that grow by batches: what a batch writes is seen once its line stands in the log, and only once."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "batch long, name string, folder string, replaces boolean"


class Batches:
    """A folder with a log of (batch, table, folder, replaces).

    ``commit`` writes each table's rows to a folder of its own attempt and then adds one file to the log. A batch that
    the log holds is skipped, so a replay changes nothing; an attempt that fails before leaves only
    files that nobody reads. A table is the union of its folders since the last one that replaces those before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG)

    def done(self, batch: int) -> bool:
        return bool(self.log().where(F.col("batch") >= batch).limit(1).collect())

    def folders(self, name: str) -> list[str]:
        """One path a batch since the table was last written whole."""
        rows = self.log().where(F.col("name") == name)
        whole = rows.agg(F.max(F.when(F.col("replaces"), F.col("batch")))).first()[0]
        return [r["folder"] for r in (rows if whole is None else rows.where(F.col("batch") >= whole)).collect()]

    def read(self, name: str, schema: str) -> DataFrame:
        folders = self.folders(name)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, batch: int, tables: dict[str, DataFrame], replaces: bool = False) -> None:
        if self.done(batch):
            return
        attempt = uuid.uuid4().hex
        lines = []
        for name, rows in tables.items():
            folder = f"{self.path}/{name}/batch={batch}-{attempt}"
            rows.write.parquet(folder)
            lines.append((batch, name, folder, replaces))
        self.spark.createDataFrame(lines, _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
