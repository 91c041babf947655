"""Readers that give one row a unit of text, and writers by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import heading_paths, paragraphs

REPLAY = "id string, query string, answer string, contexts string, reference_answer string, intent string, source_count int, tags array<string>"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row a file; doc_id is its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def plain(spark: SparkSession, path: str) -> DataFrame:
    return paragraphs(text_files(spark, path))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, place, kind, body, path): headings as Title, paragraphs as NarrativeText, with the headings above."""
    lines = text_files(spark, path).select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    placed = heading_paths(lines).where(F.trim("line") != "")
    kind = F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), "Title").otherwise("NarrativeText")
    return placed.select("doc_id", "place", kind.alias("kind"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("body"), "path")


def replay(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; comments, blank and malformed lines are skipped; a context is a string or an object with content or text."""
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parsed = rows.select(F.from_json("value", REPLAY, {"mode": "PERMISSIVE"}).alias("r")).where(F.col("r.query").isNotNull() | F.col("r.id").isNotNull()).select("r.*")
    each = F.from_json(F.coalesce("contexts", F.lit("[]")), "array<string>")
    body = F.transform(each, lambda c: F.coalesce(F.get_json_object(c, "$.content"), F.get_json_object(c, "$.text"), c))
    return parsed.withColumn("contexts", body)


def html_sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, place, section): text between headings, without scripts and styles; sections of four characters or more."""
    clean = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    cut = F.split(clean, r"(?i)(?=<h[1-4]\b)")
    rows = pages.select(key, F.posexplode(cut).alias("place", "part"))
    text = F.trim(F.regexp_replace(F.regexp_replace("part", r"<[^>]*>", " "), r"\s+", " "))
    return rows.select(key, "place", text.alias("section")).where(F.length("section") >= 4)


def write_by_source(chunks: DataFrame, path: str, mode: str = "append", most_chars: int | None = None) -> None:
    """In one folder a source; texts whole, or cut to ``most_chars`` for a store that takes no more."""
    rows = chunks if most_chars is None else chunks.withColumn("text", F.substring("text", 1, most_chars))
    rows.write.mode(mode).partitionBy("source").parquet(path)
