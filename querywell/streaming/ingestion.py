"""Files to searchable chunks: checked, told from known ones, parsed, split and published, batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import secure_filename
from ..operators.splitting import sized_chunks
from ..operators.state import cut
from .versions import Batches

#: What may be taken in, of those the formats that this library reads, and the most bytes.
EXTENSIONS = (".md", ".txt", ".html", ".htm")
MOST_BYTES = 50 * 1024 * 1024
_REGISTRY = "filename string, file_hash string, status string, size_bytes long, chunks long, batch long"
_CHUNKS = "source string, file_hash string, parent_id string, place int, chunk string, batch long"
#: What a file can come to; ``indexed`` and ``processing`` hold its name and its content.
HOLDING = ("processing", "indexed")


def incoming(spark: SparkSession, path: str, stream: bool = True, files_a_batch: int = 1000) -> DataFrame:
    """(path, content) of the files of a folder, as a stream or as they are."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return (reader.option("maxFilesPerTrigger", files_a_batch) if stream else reader).load(path).select("path", "content")


def body_of(content: Column, extension: Column) -> Column:
    """The text of a file: HTML without scripts, styles and tags, others as they are; bytes that are not UTF-8 become replacement characters."""
    text = F.make_valid_utf8(content.cast("string"))
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.when(extension.isin(".html", ".htm"), F.trim(F.regexp_replace(bare, r"\s+", " "))).otherwise(text)


class Ingestion:
    """A registry of files and their chunks, kept in one folder.

    A file comes to one of: ``rejected`` (its kind or size), ``duplicate`` (its name, or else its content, is held by
    a file of an earlier batch or by an earlier name of this one), ``failed`` (no text in it), ``indexed``.
    Batches are committed whole, so one that is cut off leaves nothing ``processing`` and is done again by the
    next run; a file that ended ``failed`` or ``rejected`` may come again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.store = Batches(spark, path)

    def registry(self) -> DataFrame:
        return self.store.read("registry", _REGISTRY)

    def chunks(self) -> DataFrame:
        return self.store.read("chunks", _CHUNKS)

    def judged(self, files: DataFrame, batch: int) -> DataFrame:
        """(path, content) -> path, filename, file_hash, size_bytes, extension, status: processing, rejected or duplicate."""
        name = secure_filename(F.element_at(F.split("path", "/"), -1))
        rows = files.select("path", name.alias("filename"), F.sha2("content", 256).alias("file_hash"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size_bytes"))
        rows = rows.withColumn("extension", F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1)))
        held = self.registry().where(F.col("status").isin(*HOLDING))
        names, hashes = held.select("filename").distinct(), held.select("file_hash").distinct()
        known = rows.join(names.withColumn("named", F.lit(True)), "filename", "left").join(hashes.withColumn("stored", F.lit(True)), "file_hash", "left")
        allowed = F.col("extension").isin(*EXTENSIONS) & (F.col("size_bytes") <= MOST_BYTES)
        marked = known.withColumn("allowed", allowed).withColumn("fresh", F.col("allowed") & F.col("named").isNull() & F.col("stored").isNull())
        # Of the fresh files of a batch, the first of each name, then the first of each content.
        of_name = F.row_number().over(Window.partitionBy("filename", "fresh").orderBy("file_hash", "path"))
        of_hash = F.row_number().over(Window.partitionBy("file_hash", "fresh").orderBy("filename"))
        first = marked.withColumn("fresh", F.col("fresh") & (of_name == 1)).withColumn("fresh", F.col("fresh") & (of_hash == 1))
        status = F.when(~F.col("allowed"), "rejected").when(F.col("fresh"), "processing").otherwise("duplicate")
        return first.select("path", "filename", "file_hash", "size_bytes", "extension", status.alias("status"))

    def apply(self, files: DataFrame, batch: int) -> None:
        """One batch of (path, content); a batch that was applied before is skipped. Only what will be indexed is parsed."""
        if self.store.done(batch):
            return
        judged = cut(self.judged(files, batch))
        taken = files.join(judged.where("status = 'processing'"), "path")
        texts = taken.select(F.struct("file_hash", "filename").alias("doc_id"), F.col("filename").alias("source"), body_of(F.col("content"), F.col("extension")).alias("text"))
        now = F.lit(batch).cast("long").alias("batch")
        parts = sized_chunks(texts.where(F.col("text").rlike(r"\S")))
        chunks = cut(parts.select(F.col("doc_id.filename").alias("source"), F.col("doc_id.file_hash").alias("file_hash"), "parent_id", "place", "chunk", now))
        counts = chunks.groupBy("file_hash").agg(F.count(F.lit(1)).alias("made"))
        rows = judged.join(counts, "file_hash", "left")
        ended = F.when(F.col("status") != "processing", F.col("status")).when(F.col("made") > 0, "indexed").otherwise("failed")
        made = F.when(ended == "indexed", F.col("made")).otherwise(0).cast("long")
        registry = rows.select("filename", "file_hash", ended.alias("status"), "size_bytes", made.alias("chunks"), now)
        self.store.commit(batch, {"chunks": chunks, "registry": registry})

    def follow(self, files: DataFrame):
        return files.writeStream.foreachBatch(lambda batch, n: self.apply(batch, n))

    def reindex(self, files: DataFrame, batch: int) -> None:
        """All files of a folder anew, in place of what the registry and the chunks held."""
        if self.store.done(batch):
            return
        fresh = Ingestion(self.store.spark, f"{self.store.path}/reindex-{batch}")
        fresh.apply(files, 0)
        now = F.lit(batch).cast("long")
        self.store.commit(batch, {"chunks": fresh.chunks().withColumn("batch", now), "registry": fresh.registry().withColumn("batch", now)}, replaces=True)
