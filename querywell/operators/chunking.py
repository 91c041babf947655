"""Splitting texts into chunks, and what surrounds a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parent_id
from .ranges import numbered

KEEP_CHARS, CHUNK, OVERLAP = 3840, 900, 120


def paragraphs(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(doc_id, text) -> doc_id, place, body: trimmed, without empty ones."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("place", "body")).select("doc_id", "place", F.trim("body").alias("body"))
    return parts.where(F.length("body") > 0)


def window_chunks(docs: DataFrame, keep: int = KEEP_CHARS, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, source, text) -> doc_id, parent_id, place, chunk; short texts stay whole, long ones become overlapping windows."""
    step = size - overlap
    starts = F.when(F.length("text") <= keep, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(step)))
    rows = docs.where(F.length("text") > 0).select("doc_id", "source", "text", F.posexplode(starts).alias("place", "start"))
    chunk = F.when(F.length("text") <= keep, F.col("text")).otherwise(F.col("text").substr(F.col("start") + 1, F.lit(size)))
    return rows.select("doc_id", parent_id(F.col("source"), F.col("doc_id")).alias("parent_id"), "place", chunk.alias("chunk"))


def heading_paths(lines: DataFrame) -> DataFrame:
    """(doc_id, place, line) of Markdown -> path: the headings above each line, joined by ' -> '.

    A heading of a level hides all deeper ones: the last of each level counts
    only while no shallower one has come since.
    """
    order = Window.partitionBy("doc_id").orderBy("place")
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    out = lines.withColumn("level", F.when(level > 0, level))
    title = F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))
    for k in range(1, 7):
        here = F.when(F.col("level") == k, F.struct(F.col("place"), title.alias("title")))
        out = out.withColumn(f"h{k}", F.last(here, ignorenulls=True).over(order)).withColumn(f"cut{k}", F.max(F.when(F.col("level") < k, F.col("place"))).over(order))
    parts = [F.when(F.col(f"h{k}.place") > F.coalesce(F.col(f"cut{k}"), F.lit(-1)), F.col(f"h{k}.title")) for k in range(1, 7)]
    return out.select("doc_id", "place", "line", F.concat_ws(" -> ", *parts).alias("path"))


def table_row(line: Column) -> Column:
    """Whether a line has two cells or more between pipes, tabs or wide gaps."""
    return F.size(F.filter(F.split(line, r"\||\t| {2,}"), lambda c: F.trim(c) != "")) >= 2


def contextual(text: Column, fields: dict[str, Column], cap: int = 160, most: int = 800) -> Column:
    """Labelled metadata before the body, for indexing."""
    labelled = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"【{k}】"), F.substring(v.cast("string"), 1, cap))) for k, v in fields.items()]
    head = F.substring(F.concat_ws(" | ", *labelled), 1, most)
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n\n"), text))


def summary_tree(chunks: DataFrame, group: int = 8, each: int = 600, most: int = 1600) -> DataFrame:
    """chunks (source, doc_id, text) -> level-1 nodes of ``group`` chunks and a level-2 root of each source with several.

    A summary is the begin of each text, in order, up to a total.
    """
    rows = chunks.select("source", "doc_id", F.substring("text", 1, each).alias("part"))
    placed = numbered(rows, "source", [F.col("doc_id").asc()]).withColumn("node", F.floor(F.col("number") / group))
    joined = lambda items: F.substring(F.array_join(F.transform(F.array_sort(items), lambda x: x["part"]), "\n"), 1, most)
    first = placed.groupBy("source", "node").agg(joined(F.collect_list(F.struct("doc_id", "part"))).alias("summary"), F.count(F.lit(1)).alias("children")).withColumn("level", F.lit(1))
    # A root reads only as many nodes as its summary can hold, whatever the source's size.
    lead = first.where(F.col("node") <= most // 2).select("source", F.struct(F.col("node").alias("doc_id"), F.substring("summary", 1, each).alias("part")).alias("x"))
    roots = lead.groupBy("source").agg(joined(F.collect_list("x")).alias("summary")).join(first.groupBy("source").agg(F.count(F.lit(1)).alias("children")).where("children > 1"), "source")
    roots = roots.select("source", F.lit(0).cast("long").alias("node"), "summary", "children", F.lit(2).alias("level"))
    return first.unionByName(roots)


def merged_by_title(lines: DataFrame) -> DataFrame:
    """(doc_id, place, line) of Markdown -> doc_id, place, body: what stands below each heading after the path of its titles.

    Headings with nothing below them give no row; lines before the first heading stay single.
    """
    order = Window.partitionBy("doc_id").orderBy("place")
    heading = F.col("line").rlike(r"^#{1,6}\s+\S")
    rows = heading_paths(lines).withColumn("section", F.sum(F.when(heading, 1).otherwise(0)).over(order)).where(~heading & (F.trim("line") != ""))
    alone = rows.where("section = 0").select("doc_id", "place", F.trim("line").alias("body"))
    below = rows.where("section > 0").groupBy("doc_id", "section", "path").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", F.trim("line").alias("line")))).alias("x"))
    merged = below.select("doc_id", "place", F.concat("path", F.lit("\n\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("body"))
    return alone.unionByName(merged)


def pooled(tokens: DataFrame, spans: DataFrame, width: int = 1024) -> DataFrame:
    """tokens (doc, begin, end, vec) and spans (doc, span, begin, end) -> doc, span, vec: the mean of the vectors that overlap each span.

    Special tokens (0, 0) do not count; a span without any token has the mean of all of its document. Both meet in the
    stretches of ``width`` characters that they touch, so a span meets only the tokens near it, and a pair counts in the first stretch it shares.
    """
    stretch = lambda c: F.floor(F.col(c) / width)
    touched = lambda rows, begin, end: rows.withColumn("stretch", F.explode(F.sequence(stretch(begin), F.greatest(stretch(begin), F.floor((F.col(end) - 1) / width)))))
    real = tokens.where((F.col("begin") != 0) | (F.col("end") != 0)).select("doc", F.col("begin").alias("b"), F.col("end").alias("e"), "vec")
    near = touched(spans.where(F.col("begin") < F.col("end")), "begin", "end").join(touched(real, "b", "e"), ["doc", "stretch"])
    near = near.where((F.col("b") < F.col("end")) & (F.col("e") > F.col("begin")) & (F.col("stretch") == F.greatest(stretch("begin"), stretch("b"))))
    mean = lambda rows, *by: rows.select(*by, F.posexplode("vec").alias("at", "x")).groupBy(*by, "at").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("vec"))
    own, whole = mean(near, "doc", "span"), mean(real, "doc")
    empty = spans.select("doc", "span").join(own.select("doc", "span"), ["doc", "span"], "left_anti")
    return own.unionByName(empty.join(whole, "doc").select("doc", "span", "vec"))
