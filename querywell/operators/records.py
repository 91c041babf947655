"""Records that are kept: facts of answers, memories, evaluation runs; and the parts of cases, rows and metadata they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.answers import stripped
from ..functions.text import tokens
from ..functions.vectors import dot
from ..streaming.versions import Batches
from .state import cut

#: Most candidates that are rescored, and what a case has where nothing is said.
CANDIDATES = 32
CASE = "id string, query string, expected_sections array<string>, expected_keywords array<string>, expected_intent string, expected_min_sources string, difficulty string, reference_answer string, expected_context_ids array<string>, tags array<string>, source string"
CASE_DEFAULTS = {"id": "", "query": "", "expected_intent": "rag_query", "difficulty": "medium", "reference_answer": "", "source": "seed"}


def facts(answers: DataFrame, sections: list[str]) -> DataFrame:
    """(id, question, answer) -> id, question, section, content ("section: text") of each of the sections that an answer has text for.

    A section stands as 【section】text or else as section: text, and ends at the next 【 or the end. No sections give no rows.
    """
    found = []
    for name in sections:
        marked, named = (F.regexp_extract("answer", rf"(?s){head}(.*?)(?=【|\z)", 1) for head in (rf"【\Q{name}\E】", rf"\Q{name}\E[：:]"))
        body = F.when(F.col("answer").contains(f"【{name}】"), stripped(marked)).otherwise(stripped(named))
        found.append(F.struct(F.lit(name).alias("section"), body.alias("body")))
    if not found:
        return answers.select("id", "question", F.lit("").alias("section"), F.lit("").alias("content")).limit(0)
    rows = answers.select("id", "question", F.inline(F.array(*found))).where("body <> ''")
    return rows.select("id", "question", "section", F.concat_ws(": ", "section", "body").alias("content"))


def should_refuse(has_context: Column, scores: Column) -> Column:
    """Whether an answer is refused: there is context, but none of it has a score."""
    return F.coalesce(has_context, F.lit(False)) & (F.size(F.coalesce(scores, F.array().cast("array<double>"))) == 0)


def case_from_json(text: Column) -> Column:
    """An evaluation case of a JSON object, with defaults for what it does not say; null if it is none."""
    raw = F.from_json(text, CASE)
    named = lambda c: F.coalesce(raw[c], F.lit(CASE_DEFAULTS[c])) if c in CASE_DEFAULTS else F.coalesce(raw[c], F.array().cast("array<string>"))
    number = F.coalesce(raw["expected_min_sources"].try_cast("int"), F.lit(0))
    fields = [part.strip().split(" ")[0] for part in CASE.split(", ")]
    case = F.struct(*((number if c == "expected_min_sources" else named(c)).alias(c) for c in fields))
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), case)


def scalar_metadata(text: Column, dropped: tuple[str, ...] = ("_late_chunk_dense",)) -> Column:
    """Of a JSON object the strings, numbers and truth values by key, as text: what may become a column. Null if it is none."""
    values = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    single = F.map_filter(values, lambda k, v: ~k.isin(*dropped) & ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"))
    return F.transform_values(single, lambda k, v: F.try_variant_get(v, "$", "string"))


def row_cells(line: Column) -> Column:
    """The cells of a table row: between pipes, else tabs, else wide gaps; stripped, without empty ones."""
    parts = F.when(line.contains("|"), F.split(line, r"\|")).when(line.contains("\t"), F.split(line, "\t")).when(line.rlike(r"\s{2,}"), F.split(line, r"\s{2,}"))
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), stripped), lambda c: c != "")


def late_rerank(hits: DataFrame, queries: DataFrame, documents: DataFrame, k: int, most: int = CANDIDATES) -> DataFrame:
    """hits (qid, id, rank from 1), queries (qid, tokens) and documents (id, tokens), unit vectors -> qid, id, place, score, applied.

    The first min(k, most) hits of a query are put in the order of the mean over its tokens of the best token of each; score is
    that mean scaled to 0..1 over them. The others follow as they were, without a score. Queries without tokens keep their order.
    Callers bound the tokens. The hits are read twice, so they are written first: the search behind them runs once.
    """
    hits = cut(hits)
    asked = queries.where(F.size("tokens") > 0).select("qid", F.col("tokens").alias("asked"))
    near = hits.where(F.col("rank") <= min(k, most)).join(asked, "qid").join(documents.select("id", "tokens"), "id")
    best = F.transform("asked", lambda q: F.array_max(F.transform("tokens", lambda d: dot(q, d))))
    raw = near.select("qid", "id", "rank", (F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size("asked")).alias("raw"))
    pool = Window.partitionBy("qid")
    low, high = F.min("raw").over(pool), F.max("raw").over(pool)
    scaled = F.when(high - low > 1e-12, (F.col("raw") - low) / (high - low)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("raw") + 1) / 2)))
    scored = raw.select("qid", "id", F.row_number().over(pool.orderBy(F.desc(F.round("raw", 9)), "rank")).alias("new_place"), scaled.alias("score"))
    rows = hits.join(scored, ["qid", "id"], "left")
    return rows.select("qid", "id", F.coalesce("new_place", "rank").alias("place"), "score", F.col("new_place").isNotNull().alias("applied"))


def enriched(questions: DataFrame, memories: DataFrame, least: int = 4, k: int = 5) -> DataFrame:
    """questions (id, question) and memories (memory, content, weight) -> id, memories: up to k memories that share a word with the question.

    Words have ``least`` characters or more; memories go by their number of shared words, then weight, then name. Only words that both sides
    hold are joined, with the questions' side counted first. Questions without any get an empty list.
    """
    terms = lambda rows, key, text: rows.select(key, F.explode(F.array_distinct(tokens(F.coalesce(text, F.lit(""))))).alias("term")).where(F.length("term") >= least)
    asked = terms(questions, "id", "question")
    held = terms(memories, "memory", "content").join(asked.select("term").distinct(), "term", "left_semi")
    shared = held.join(asked, "term").groupBy("id", "memory").agg(F.count(F.lit(1)).alias("shared")).join(memories.select("memory", "weight"), "memory")
    order = Window.partitionBy("id").orderBy(F.desc("shared"), F.desc("weight"), "memory")
    best = shared.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    listed = best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "memory"))), lambda x: x["memory"]).alias("memories"))
    return questions.select("id").join(listed, "id", "left").select("id", F.coalesce("memories", F.array().cast(listed.schema["memories"].dataType)).alias("memories"))


class Records:
    """Memories and evaluation runs in one folder, each batch of them seen once."""

    MEMORIES = "id string, kind string, content string, question string, at long"
    RUNS = "run_id string, tag string, at long, total long, passed long, failed long, average double"
    DETAILS = "run_id string, case_id string, score double"

    def __init__(self, spark: SparkSession, path: str):
        self.store = Batches(spark, path)

    def remember(self, memories: DataFrame, batch: int) -> None:
        """(kind, content, question, at) under an id of their own content, so that the same memory is one."""
        key = F.substring(F.sha2(F.concat_ws("|", "kind", "question", "content"), 256), 1, 16)
        self.store.commit(batch, {"memories": memories.select(key.alias("id"), "kind", "content", "question", F.col("at").cast("long").alias("at"))})

    def memories(self) -> DataFrame:
        """Each memory once, as of its first time."""
        return self.store.read("memories", self.MEMORIES).groupBy("id", "kind", "content", "question").agg(F.min("at").alias("at"))

    def save_run(self, scores: DataFrame, run_id: str, tag: str, at: int, batch: int, threshold: float = 0.6) -> None:
        """(case_id, score) of one run, with its summary; a case without a score has failed."""
        rows = scores.select(F.lit(run_id).alias("run_id"), F.col("case_id").cast("string").alias("case_id"), F.col("score").cast("double").alias("score"))
        passed = F.count_if(F.col("score") >= threshold)
        summary = rows.agg(F.lit(run_id).alias("run_id"), F.lit(tag).alias("tag"), F.lit(at).cast("long").alias("at"), F.count(F.lit(1)).alias("total"), passed.alias("passed"), (F.count(F.lit(1)) - passed).alias("failed"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("average"))
        self.store.commit(batch, {"runs": summary, "details": rows})

    def history(self, limit: int | None = None) -> DataFrame:
        """Summaries of the last runs."""
        runs = self.store.read("runs", self.RUNS)
        return runs if limit is None else runs.orderBy(F.desc("at"), F.desc("run_id")).limit(limit)

    def details(self, run_id: str) -> DataFrame:
        return self.store.read("details", self.DETAILS).where(F.col("run_id") == run_id)
