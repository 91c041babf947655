"""Checks and clean-ups of texts, answers and parsed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.chunking import table_row


def page_text(text: Column) -> Column:
    """Without NUL, one kind of line end, blanks around lines gone, at most one empty line in a row."""
    out = F.replace(F.replace(F.replace(text, F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def table_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, id, first, n: runs of two or more lines that look like rows of a table."""
    at = Window.partitionBy("doc_id").orderBy("place")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("is_row", table_row(F.col("line")))
    runs = lines.withColumn("new", ~F.col("is_row").eqNullSafe(F.lag("is_row").over(at))).withColumn("run", F.sum(F.col("new").cast("int")).over(at))
    blocks = runs.where("is_row").groupBy("doc_id", "run").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    return blocks.select("doc_id", F.concat(F.lit("page_"), F.col("doc_id").cast("string"), F.lit("_table_"), number.cast("string")).alias("id"), "first", "n")


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: rows padded to the widest, the first one as its head."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    head, body = F.slice(F.transform(rows, line), 1, 1), F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line)
    return F.array_join(F.concat(head, F.array(F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))), body), "\n")


def description(text: Column, most: int = 100) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")), 1, most)


def chunk_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3.2)).cast("int")


def keyword_intent(text: Column, rag: list[str], chat: list[str]) -> Column:
    """rag if any of its keywords stands in the text, else chat by whole words, else null."""
    low = F.lower(text)
    held = F.exists(F.array(*map(F.lit, rag)), lambda k: low.contains(k))
    words = "|".join(chat)
    return F.when(held, "rag").when(low.rlike(rf"(^|[^a-z0-9_])({words})([^a-z0-9_]|$)"), "chat")


def transform_decision(explicit: Column, query: Column, anchors: str, diagnostic: list[str], symptoms: list[str]) -> Column:
    """What is asked for; none for a precise anchor; hyde for a diagnostic word; multi_query for a short symptom."""
    q = F.trim(F.coalesce(query, F.lit("")))
    held = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: q.contains(w)) if words else F.lit(False)
    guessed = F.when((q == "") | q.rlike(anchors), None).when(held(diagnostic), "hyde").when((F.length(q) <= 12) & held(symptoms), "multi_query")
    return F.coalesce(explicit, guessed)


def structure(answer: Column, leading: list[str], closing: list[str], least: int = 50) -> Column:
    """allow, or why the hint on structure is added: the end is cut off, or no section leads."""
    held = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: answer.contains(w))
    return F.when((F.length(answer) <= least) | (held(leading) & held(closing)), "allow").when(held(leading), "sanitize:cut").otherwise("sanitize:unstructured")


def output_verdict(hallucinated: Column, risky: Column, unstructured: Column, personal: Column) -> tuple[Column, Column]:
    """(action, redacted): an escalation stays one, the first clean-up wins, and personal data is redacted on top of any."""
    action = F.when(hallucinated, "escalate").when(risky | unstructured | personal, "sanitize").otherwise("allow")
    return action, personal


def grounding(hard: Column, supported: Column) -> Column:
    """Supported share of the hard claims; 1 without any, null where they could not be judged."""
    none = hard.isNull() | (hard == 0)
    return F.when(hard.isNull(), 1.0).when(supported.isNull(), None).when(none, 1.0).otherwise(supported / hard)


def element_tree(elements: DataFrame) -> DataFrame:
    """(idx, parent) -> idx, parent, forward: a parent counts only if it is known and comes before; forward if it comes later."""
    known = elements.select(F.col("idx").alias("__p"), F.lit(True).alias("__known"))
    met = elements.join(known, F.col("parent") == F.col("__p"), "left")
    before = F.coalesce(F.col("__known") & (F.col("parent") < F.col("idx")), F.lit(False))
    return met.select("idx", F.when(before, F.col("parent")).alias("parent"), F.coalesce(F.col("__known") & (F.col("parent") >= F.col("idx")), F.lit(False)).alias("forward"))
