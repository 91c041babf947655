"""A lexical index that follows a stream of documents: signed changes of its statistics, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.state import cut
from .versions import Batches

_DOCS = "doc_id string, source string, version long, length long, terms array<string>"
_GONE = "doc_id string, version long"
_TERMS = "term string, df long"
_TOTALS = "n long, length long"


class LexicalIndex:
    """Document frequencies, number and length of documents, as sums of what each batch added and took away.

    A change is (doc_id, source, text, removed): with ``removed`` it takes away the document, or without a
    doc_id the whole source; else it adds the document, in place of what has its id. A batch first takes away,
    then adds. Rows of one id in a batch: the greatest text stays. Statistics need no pass over the texts
    that are indexed already: a batch joins its ids and sources with the (doc_id, source, terms) rows alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.store = Batches(spark, path)

    def live(self) -> DataFrame:
        """doc_id, source, version, length, terms (distinct) of the documents that are indexed."""
        docs, gone = self.store.read("documents", _DOCS), self.store.read("gone", _GONE)
        return docs.join(gone, ["doc_id", "version"], "left_anti")

    def term_stats(self) -> DataFrame:
        """term, df of the terms that some document holds."""
        return self.store.read("terms", _TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def totals(self) -> DataFrame:
        """One row: n documents, their mean length (0 of none)."""
        sums = self.store.read("totals", _TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
        return sums.select("n", F.when(F.col("n") > 0, F.col("length") / F.col("n")).otherwise(0.0).alias("mean_length"))

    def apply(self, changes: DataFrame, batch: int) -> None:
        """One batch; a batch that was applied before is skipped."""
        if self.store.done(batch):
            return
        rows = changes.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text", F.coalesce("removed", F.lit(False)).alias("removed"))
        named = rows.where("not removed and doc_id is not null")
        last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("text"), F.desc_nulls_last("source")))
        found = named.withColumn("place", last).where("place = 1").withColumn("tokens", tokens(F.coalesce("text", F.lit(""))))
        added = cut(found.select("doc_id", "source", F.lit(batch).cast("long").alias("version"), F.size("tokens").cast("long").alias("length"), F.array_distinct("tokens").alias("terms")))
        ids = rows.where("doc_id is not null").select("doc_id").distinct()
        sources = rows.where("removed and doc_id is null").select("source").distinct()
        live = self.live()
        by_id = live.join(ids, "doc_id", "left_semi")
        by_source = live.join(sources, "source", "left_semi").select(*live.columns)
        gone = cut(by_id.unionByName(by_source).dropDuplicates(["doc_id", "version"]))
        signed = added.select("terms", "length", F.lit(1).alias("sign")).unionByName(gone.select("terms", "length", F.lit(-1).alias("sign")))
        terms = signed.select(F.explode("terms").alias("term"), "sign").groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0")
        totals = signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("length")), F.lit(0)).alias("length"))
        self.store.commit(batch, {"documents": added, "gone": gone.select("doc_id", "version"), "terms": terms, "totals": totals})

    def compact(self, batch: int) -> None:
        """The whole state as one batch, in place of the changes before it."""
        if self.store.done(batch):
            return
        sums = self.store.read("totals", _TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
        gone = self.store.read("gone", _GONE).limit(0)
        self.store.commit(batch, {"documents": self.live(), "gone": gone, "terms": self.term_stats(), "totals": sums}, replaces=True)

    def follow(self, changes: DataFrame):
        """A stream writer that applies each of its batches."""
        return changes.writeStream.foreachBatch(lambda batch, n: self.apply(batch, n))
