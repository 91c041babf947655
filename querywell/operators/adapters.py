"""Question sets as cases and chunks, links of elements to their titles, and feedback that turns into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import stripped
from ..functions.text import content_id
from .state import cut

#: Characters of a passage and chunks a case expects at most: fixed values of the adapters.
PASSAGE, EXPECTED = 1000, 3
#: Characters of a chunk of a context, of the overlap with the next, and where its sentences end.
CHUNK, OVERLAP, ENDS = 400, 40, "(?<=[。！？!?])"


def selected_passages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (qid, place, text, selected, answered) -> cases (qid, expected) and chunks (id, text).

    Questions without an answer or without a selected passage are left out, with their passages. A passage is its
    first PASSAGE characters and has the id of its content; a case expects the first EXPECTED distinct selected ones.
    """
    cut_text = rows.withColumn("text", F.substring("text", 1, PASSAGE)).where(F.trim("text") != "")
    chosen = F.coalesce(F.col("selected"), F.lit(False)) & F.coalesce(F.col("answered"), F.lit(False))
    some = F.max(chosen.cast("int")).over(Window.partitionBy("qid"))
    kept = cut_text.withColumn("__some", some).where("__some = 1").withColumn("id", content_id(F.col("text")))
    return _expected(kept.where(chosen).select("qid", "place", "id")), _chunks(kept)


def supported_passages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (qid, place, title, sentences, supports) -> cases and chunks: paragraphs are joined sentences.

    A case expects the paragraphs whose title is among the supports, or its first two where none is.
    """
    joined = rows.withColumn("text", F.substring(F.array_join("sentences", " "), 1, PASSAGE)).where(F.trim("text") != "").withColumn("id", content_id(F.col("text")))
    each = Window.partitionBy("qid")
    fact = F.coalesce(F.array_contains("supports", F.col("title")), F.lit(False))
    marked = joined.withColumn("__fact", fact).withColumn("__any", F.max(fact.cast("int")).over(each)).withColumn("__n", F.row_number().over(each.orderBy("place")))
    return _expected(marked.where((F.col("__any") == 1) & F.col("__fact") | (F.col("__any") == 0) & (F.col("__n") <= 2)).select("qid", "place", "id")), _chunks(joined)


def context_chunks(context: Column) -> Column:
    """Sentences put together up to CHUNK characters; the next chunk begins with the last OVERLAP ones. A sentence is never cut."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, sentence: Column) -> Column:
        tail = F.when(F.length(state["open"]) > OVERLAP, F.substring(state["open"], -OVERLAP, OVERLAP)).otherwise("")
        full = (F.length(state["open"]) + F.length(sentence) > CHUNK) & (state["open"] != "")
        done = F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.concat(F.when(full, tail).otherwise(state["open"]), sentence).alias("open"))

    finish = lambda state: F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
    return F.aggregate(F.split(context, ENDS), start, step, finish)


def span_passages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (qid, question, context, gold, start) -> cases (qid, expected) and chunks (id, text); qid is unique.

    Rows without a question, a context or an answer are left out. The expected chunk is the one in whose share of the
    summed lengths the answer starts, else the first that holds it; a row with neither has chunks but no case.
    """
    usable = rows.where((F.col("question") != "") & (F.col("context") != "") & (F.col("gold") != ""))
    parts = usable.select("qid", "gold", "start", F.posexplode(context_chunks(F.col("context"))).alias("place", "part"))
    past = F.sum(F.length("part")).over(Window.partitionBy("qid").orderBy("place"))
    placed = parts.withColumn("past", past).withColumn("text", F.substring(stripped(F.col("part")), 1, PASSAGE)).withColumn("id", content_id(F.col("text")))
    there = F.coalesce((F.col("start") >= F.col("past") - F.length("part")) & (F.col("start") < F.col("past")), F.lit(False))
    met = placed.withColumn("miss", F.when(there, 0).when(F.contains("part", F.col("gold")), 1)).where("miss is not null")
    cases = met.groupBy("qid").agg(F.array(F.min_by("id", F.struct("miss", "place"))).alias("expected"))
    return cases, _chunks(placed)


def _expected(rows: DataFrame) -> DataFrame:
    """The first EXPECTED distinct ids of a question, in order of place."""
    first = rows.groupBy("qid", "id").agg(F.min("place").alias("place"))
    few = first.withColumn("__n", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).where(F.col("__n") <= EXPECTED)
    return few.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "id"))), lambda x: x["id"]).alias("expected"))


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.min("text").alias("text"))


def title_links(elements: DataFrame, separator: str = " -> ") -> DataFrame:
    """elements (doc, idx, parent, is_title, body) -> doc, idx, title, path; a parent that is unknown or not before counts as none.

    A title is its own nearest one; its path is the titles from the root to it. Each round joins every open element
    with where its pointer stands and doubles the way gone, so the rounds grow with the logarithm of the depth.
    """
    own = F.coalesce(F.col("is_title"), F.lit(False))
    none = F.array().cast("array<string>")
    rows = cut(elements.select("doc", "idx", F.when(F.col("parent") < F.col("idx"), F.col("parent")).alias("up"), F.when(own, F.col("idx")).alias("title"), F.when(own, F.array(F.coalesce("body", F.lit("")))).otherwise(none).alias("titles")))
    while rows.where("up is not null").limit(1).count():
        above = rows.select(F.col("doc").alias("__doc"), F.col("idx").alias("__at"), F.col("up").alias("__up"), F.col("title").alias("__title"), F.col("titles").alias("__titles"))
        met = rows.where("up is not null").join(above, (F.col("doc") == F.col("__doc")) & (F.col("up") == F.col("__at")), "left")
        stepped = met.select("doc", "idx", F.col("__up").alias("up"), F.coalesce("title", "__title").alias("title"), F.concat(F.coalesce("__titles", none), "titles").alias("titles"))
        rows = cut(rows.where("up is null").unionByName(stepped))
    return rows.select("doc", "idx", "title", F.array_join("titles", separator).alias("path"))


def flywheel(feedback: DataFrame, inferences: DataFrame, least: float = 0.5) -> DataFrame:
    """feedback (trace, negative, corrected) and inferences (trace, query, answer, faithfulness) -> candidates.

    Each negative feedback on a logged inference gives one candidate; its reference is the corrected answer if there is
    one. It is a retrieval miss if the faithfulness is known and under ``least``.
    """
    met = feedback.where("negative").join(inferences, "trace")
    reference = F.coalesce(F.nullif(F.trim("corrected"), F.lit("")), F.col("answer"))
    miss = F.coalesce((F.col("faithfulness") < least) & ~F.isnan("faithfulness"), F.lit(False))
    return met.select("trace", "query", reference.alias("reference"), miss.alias("miss"))


def escalated(rows: DataFrame, level: Column, answer: str, warning: str) -> DataFrame:
    """Rows of level high or critical are escalated and get the warning after their answer; the others stay as they are."""
    up = F.coalesce(level.isin("high", "critical"), F.lit(False))
    return rows.withColumn("level", level).withColumn("escalated", up).withColumn(answer, F.when(up, F.concat(F.coalesce(answer, F.lit("")), F.lit("\n\n" + warning))).otherwise(F.col(answer)))


def matches(query: Column, keywords: list[str], patterns: list[str]) -> Column:
    """Whether a query holds a keyword, in any case, or a pattern finds something in it; null holds nothing."""
    out = F.lit(False)
    for word in keywords:
        out = out | F.contains(F.lower(query), F.lit(word.lower()))
    for pattern in patterns:
        out = out | query.rlike(pattern)
    return F.coalesce(out, F.lit(False))
