"""Evidence rows: what a retrieved document becomes on its way to an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import probability, sigmoid

#: Most characters of a content, and of a source or title; most items of a list.
CONTENT, NAME, ITEMS = 4000, 500, 64
#: Probabilities at which evidence in another language is let pass: its own, and that of a strong hit.
FOREIGN, STRONG = 0.01, 0.9
#: Words of which an English text holds two at least.
ENGLISH = "the this these those is are must shall before after only when if with and not how to".split()


def projected(rows: DataFrame) -> DataFrame:
    """(id, content, source, title, grade, rerank_prob, rerank_score) -> id, content, source, title, score, degraded.

    The score is the grade, else the reranker's probability, else its score through
    the logistic function; the first that is a number in 0..1. Texts are cut;
    a row that was cut is degraded.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    score = F.coalesce(probability(F.col("grade")), probability(F.col("rerank_prob")), sigmoid(F.col("rerank_score")))
    cut = (F.length(text("content")) > CONTENT) | (F.length(text("source")) > NAME) | (F.length(text("title")) > NAME)
    return rows.select("id", F.substring(text("content"), 1, CONTENT).alias("content"), F.substring(text("source"), 1, NAME).alias("source"), F.substring(text("title"), 1, NAME).alias("title"), score.alias("score"), cut.alias("degraded"))


def valid(content: Column, source: Column, title: Column, score: Column) -> Column:
    """Whether an evidence row has all its parts within their limits and no score or one in 0..1."""
    held = content.isNotNull() & source.isNotNull() & title.isNotNull()
    short = (F.length(content) <= CONTENT) & (F.length(source) <= NAME) & (F.length(title) <= NAME)
    return held & short & (score.isNull() | probability(score).isNotNull())


def wire_safe(value: Column) -> Column:
    """Whether a string or number may be sent as it is."""
    return F.coalesce(F.length(value.cast("string")) <= CONTENT, F.lit(True)) & F.coalesce(~F.isnan(value.try_cast("double")) & (F.abs(value.try_cast("double")) < float("inf")), F.lit(True))


def normalised(rows: DataFrame, by: str) -> DataFrame:
    """(by, ok, degraded) of the items of a list -> by, usable, degraded: one invalid item makes the whole list unusable and degraded."""
    every = rows.groupBy(by).agg(F.bool_and("ok").alias("usable"), F.bool_or("degraded").alias("degraded"))
    return every.select(by, "usable", (~F.col("usable") | F.col("degraded")).alias("degraded"))


def lines(rows: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, content, source, title, score) -> by, order, number, line: numbered headers; rows without content take no number."""
    kept = rows.where(F.coalesce(F.col("content"), F.lit("")) != "")
    numbered = kept.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    line = F.format_string("[证据%d] 来源=%s | 标题=%s | 相关度=%.4f", "number", F.coalesce("source", F.lit("unknown")), F.coalesce("title", F.lit("unknown")), F.coalesce("score", F.lit(0.0)))
    return numbered.select(by, order, "number", line.alias("line"))


def language(text: Column) -> Column:
    """zh, en or null: null if other letters or, beside Chinese, an English phrase stand in it, or too few English words."""
    letters = text.rlike(r"[^\P{L}a-zA-Z\x{4e00}-\x{9fff}]")
    chinese = text.rlike(r"[\x{4e00}-\x{9fff}]")
    phrase = text.rlike(r"\b[A-Za-z]{2,}(?:[ -]+[A-Za-z]{2,})+\b")
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))
    english = F.size(F.array_intersect(words, F.array(*map(F.lit, ENGLISH)))) >= 2
    return F.when(letters, None).when(chinese, F.when(~phrase, "zh")).when(english, "en")


def eligible(rows: DataFrame, by: str, asked: str) -> DataFrame:
    """(by, lang, score) of evidence -> the rows in the asked language of those lists that may be used.

    A list is out if it holds a row in another language, unless that row's
    probability is FOREIGN at most and the list has a row in the language with
    STRONG at least.
    """
    own = F.coalesce(F.col("lang") == F.lit(asked), F.lit(False))
    each = Window.partitionBy(by)
    strong = F.max((own & F.coalesce(F.col("score") >= STRONG, F.lit(False))).cast("int")).over(each) == 1
    marked = rows.withColumn("__own", own).withColumn("__strong", strong)
    bad = ~F.col("__own") & (~F.col("__strong") | F.col("score").isNull() | (F.col("score") > FOREIGN))
    spoilt = marked.withColumn("__bad", F.max(bad.cast("int")).over(each))
    return spoilt.where((F.col("__bad") == 0) & F.col("__own")).drop("__own", "__strong", "__bad")


def reference_groups(sentences: DataFrame, by: str, order: str, pattern: str) -> DataFrame:
    """(by, order, body) -> by, clause, body: a sentence that begins with a word of reference is glued to the one before it."""
    at = Window.partitionBy(by).orderBy(order)
    first = (F.row_number().over(at) == 1) | ~F.col("body").rlike(pattern)
    placed = sentences.withColumn("__first", first).withColumn("clause", F.sum(F.col("__first").cast("int")).over(at))
    joined = placed.groupBy(by, "clause").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("body").alias("b")))).alias("x"))
    return joined.select(by, "clause", F.array_join(F.transform("x", lambda x: x["b"]), "").alias("body"))
