"""Reading what a model or a user wrote: sections, items, scores, JSON, verdicts, dialogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a line says no (looked for first) and yes, the keys of a JSON verdict in order, names of roles, the mark of a score.
NO = r"(?i)^\s*(no|false|否|不是|不支持|未支持|矛盾|无关|错误|不符合)"
YES = r"(?i)^\s*(yes|true|是|支持|可支持|蕴含|符合|正确)"
VERDICT_KEYS = ("supported", "answer", "result", "entailment", "relevant")
ROLES = {"human": "用户", "ai": "助手"}
SCORE = r"相关度=([\d.]+)"
BLANK = r"^\s+|\s+$"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, BLANK, "")


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def section(text: Column, title: str, following: list[str]) -> Column:
    """What stands between 【title】 and the nearest of the following titles; empty without the title."""
    rest = F.get(F.split(text, rf"【\Q{title}\E】", 2), F.lit(1))
    if following:
        ends = "|".join(rf"\Q{t}\E" for t in following)
        rest = F.get(F.split(rest, f"【(?:{ends})】", 2), F.lit(0))
    return F.coalesce(stripped(rest), F.lit(""))


def numbered_items(text: Column) -> Column:
    """The texts of numbered lines; all lines that are not blank, without dashes, if none is numbered."""
    numbered = F.regexp_extract_all(text, F.lit(r"(?:^|\n)\s*\d+[.)、]\s*([^\n]+)"), F.lit(1))
    items = F.filter(F.transform(numbered, stripped), lambda x: x != "")
    plain = F.transform(F.filter(lines(text), lambda x: stripped(x) != ""), lambda x: stripped(F.regexp_replace(x, r"^[- ]+|[- ]+$", "")))
    return F.when(F.size(numbered) > 0, items).otherwise(plain)


def line_value(text: Column, key: str) -> Column:
    """The value of a line "key: value", whatever the case of the key; null without one."""
    return F.nullif(F.regexp_extract(text, rf"(?im)^\s*\Q{key}\E\s*:[^\S\n]*(\S[^\n]*?)\s*$", 1), F.lit(""))


def query_lines(raw: Column, n: int) -> Column:
    """Up to n lines of four characters or more, without their numbering."""
    clean = F.transform(lines(raw), lambda x: F.regexp_replace(stripped(x), r"^[0-9.\-、）):： ]+", ""))
    return F.slice(F.filter(clean, lambda x: F.length(x) >= 4), 1, n)


def query_variants(query: Column, raw: Column, n: int = 3) -> Column:
    """The query and up to n distinct other ways of asking it."""
    return F.slice(F.array_distinct(F.concat(F.array(query), query_lines(raw, n))), 1, n + 1)


def relevance_scores(context: Column) -> Column:
    found = F.transform(F.regexp_extract_all(context, F.lit(SCORE), F.lit(1)), lambda x: x.try_cast("double"))
    return F.filter(found, lambda x: x.isNotNull())


def dataset_slug(name: Column) -> Column:
    readable = F.regexp_replace(F.regexp_replace(F.lower(stripped(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.substring(F.when(readable == "", "dataset").otherwise(readable), 1, 48), F.lit("-"), F.substring(F.sha2(name, 256), 1, 10))


def model_fingerprint(model: Column, dimension: Column, sparse: Column) -> Column:
    return F.substring(F.sha1(F.concat(model, F.lit("|"), dimension.cast("int").cast("string"), F.lit("|sparse="), sparse.cast("int").cast("string"))), 1, 12)


def generated_id(source: Column, place: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.coalesce(source, F.lit("")), F.lit("#"), place.cast("string"), F.lit("#"), F.substring(text, 1, 256)), 256), 1, 16)


def evidence_key(parent: Column, chunk: Column, source: Column, page: Column, text: Column) -> Column:
    """parent:<id>, else chunk:<id>, else orphan:<sha1 of source|page|text>."""
    known = lambda x: F.nullif(x.cast("string"), F.lit(""))
    orphan = F.sha1(F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(page.cast("string"), F.lit("")), text))
    return F.coalesce(F.concat(F.lit("parent:"), known(parent)), F.concat(F.lit("chunk:"), known(chunk)), F.concat(F.lit("orphan:"), orphan))


def dialog(messages: DataFrame, by: str, order: str, role: str, text: str, names: dict[str, str] | None = None, last: int = 6, most: int = 150) -> DataFrame:
    """The last messages of each dialog in order, one "role: begin of the text" a line."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    named = F.col(role)
    for known, name in (names or ROLES).items():
        named = F.when(F.col(role) == known, name).otherwise(named)
    line = F.concat(named, F.lit(": "), F.substring(F.coalesce(text, F.lit("")), 1, most))
    kept = messages.withColumn("__place", place).where(F.col("__place") <= last).select(by, F.struct(F.col(order), line.alias("line")).alias("x"))
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("dialog"))


def json_object(text: Column) -> Column:
    """The JSON object of a reply as a variant: the reply itself or its outermost braces, without fences and trailing commas; null if none parses."""

    def parsed(candidate: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(stripped(candidate), r"^```[a-zA-Z]*\n?", ""), r"\n?```$", "")
        value = F.try_parse_json(F.regexp_replace(bare, r",\s*([}\]])", "$1"))
        return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)

    return F.coalesce(parsed(text), parsed(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def line_verdict(text: Column) -> Column:
    """What the first line with a verdict says."""
    said = F.transform(lines(text), lambda x: F.when(x.rlike(NO), F.lit(False)).when(x.rlike(YES), F.lit(True)))
    return F.get(F.filter(said, lambda x: x.isNotNull()), F.lit(0))


def verdict(text: Column) -> Column:
    """True, false or null: a JSON verdict (boolean, number over 0.5 or words) by the first key it has, else by lines."""
    held = json_object(text)
    out = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for key in VERDICT_KEYS:
        value = F.try_variant_get(held, f"$.{key}", "variant")
        kind = F.schema_of_variant(value)
        out = out.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        out = out.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double") > 0.5)
        out = out.when(kind == "STRING", line_verdict(F.try_variant_get(value, "$", "string")))
    return out.otherwise(line_verdict(text))


def grade(text: Column) -> Column:
    """1.0 or 0.0 for a JSON boolean "relevant"; anything else is null."""
    value = F.try_variant_get(json_object(text), "$.relevant", "variant")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast("double"))
