"""Column functions that clean values and replies, and put answers together."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .answers import numbered_items, section, stripped
from .text import strip_think

#: Hints that a reply's writer adds (the text's end is \z in Java), the keys of a grade in their order, and its words.
CAVEATS = r"(?s)>\s*[⚠️🤔💡]\s*.*?(?=\n\n|\z)|[⚠️🤔💡]\s*[^。\n]*(?:推理|不确定性|假设|参考|仅[供为])[^。\n]*[。.\n]?"
GRADE_KEYS = ("binary_score", "score", "answer", "relevant", "relevance")
NO, YES = ("no", "false", "not relevant", "irrelevant", "0"), ("yes", "true", "relevant", "1")


@F.pandas_udf(StringType())
def compatible(value: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for; null stays."""
    return pd.Series([None if v is None else unicodedata.normalize("NFKC", v) for v in value], dtype=object)


def metadata_value(value: Column, is_source: bool = False) -> Column:
    """In compatible characters, without control and format ones and angle brackets, white space collapsed; of a source only the name."""
    plain = compatible(value)
    if is_source:
        plain = F.regexp_extract(F.replace(plain, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)
    plain = F.translate(F.regexp_replace(plain, r"[\p{Cc}\p{Cf}\p{Cs}]", " "), "<>", "‹›")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def cited_paragraph(text: Column, ids: Column, sources: Column) -> Column:
    """The text and [name] of each source once, in order; 证据N where it has no name. Null if the text is blank or a number unknown."""
    body = stripped(strip_think(text))
    name = F.transform(ids, lambda i: F.coalesce(F.nullif(F.get(sources, i - 1), F.lit("")), F.concat(F.lit("证据"), i.cast("string"))))
    marks = F.array_join(F.transform(F.array_distinct(name), lambda x: F.concat(F.lit("["), x, F.lit("]"))), "")
    known = F.forall(ids, lambda i: (i >= 1) & (i <= F.size(sources)))
    return F.when((body != "") & known, F.concat(body, marks))


def structured_answer(text: Column, titles: list[str]) -> Column:
    """The sections of an answer by place: summary, details, steps, notes, sources, gaps; null if it has none of them."""
    parts = [section(text, title, titles[n + 1 :]) for n, title in enumerate(titles)] + [F.lit("")] * (6 - len(titles))
    some = F.concat(*parts) != ""
    listed = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(numbered_items(x))
    whole = F.struct(parts[0].alias("summary"), listed(parts[1]).alias("details"), listed(parts[2]).alias("steps"), parts[3].alias("notes"), listed(parts[4]).alias("sources"), parts[5].alias("gaps"))
    return F.when(some, whole)


def without_boilerplate(text: Column, added: list[str]) -> Column:
    """Without the phrases that are always added and without hints about uncertainty."""
    for phrase in (p.strip() for p in added if p.strip()):
        text = F.replace(text, F.lit(phrase), F.lit(""))
    return stripped(F.regexp_replace(text, CAVEATS, ""))


def relevant(reply: Column) -> Column:
    """Of a JSON object the first grade by key that is a known word, else false; of other text whether it says yes; null is false."""
    held = F.get_json_object(reply, "$").isNotNull() & F.trim(reply).startswith("{")
    out = F.lit(False)
    for key in reversed(GRADE_KEYS):
        word = F.lower(F.trim(F.get_json_object(reply, f"$.{key}")))
        out = F.when(word.isin(*NO), False).when(word.isin(*YES), True).otherwise(out)
    return F.when(held, out).otherwise(F.coalesce(F.contains(F.lower(reply), F.lit("yes")), F.lit(False)))
