"""Replies of an extraction model to entities and relations; all in column functions, a chunk by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_id
from .state import once

_BLANKS = " \t\n\x0b\f\r"
_ENTITIES = "array<struct<name string, type string, description string>>"
_RELATIONS = "array<struct<src string, tgt string, type string, description string>>"


def _objects(replies: DataFrame, columns: list[str]) -> DataFrame:
    """columns, data: the JSON object of a reply, as a variant: the reply without code fences, else from its first { to its last }; null if neither is one."""
    bare = once(replies, columns, bare=_plain(F.col("reply")))
    fenced = F.regexp_replace(F.regexp_replace("bare", r"^```[a-zA-Z]*\n?", ""), r"\n?```$", "")
    bare = once(bare, columns, unfenced=F.when(F.startswith("bare", F.lit("```")), fenced).otherwise(F.col("bare")))
    tried = once(bare, [*columns, "unfenced"], whole=F.try_parse_json("unfenced"))
    # JSON that begins with a brace is an object; what is searched for begins with one.
    named = F.ltrim("unfenced", F.lit(_BLANKS)).startswith("{")
    part = F.try_parse_json(F.nullif(F.regexp_extract("unfenced", r"(?s)\{.*\}", 0), F.lit("")))
    return once(tried, columns, data=F.when(F.col("whole").isNotNull(), F.when(named, F.col("whole"))).otherwise(part))


def _items(key: str, kind: str) -> Column:
    """The objects of a list in data; what is no object comes as null and goes."""
    return F.filter(F.coalesce(F.try_variant_get(F.col("data"), f"$.{key}", kind), F.array().cast(kind)), lambda x: x.isNotNull())


def _said(item: Column, key: str) -> Column:
    return F.coalesce(item[key], F.lit(""))


def _plain(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _entity(x: Column) -> Column:
    return F.struct(_plain(_said(x, "name")).alias("name"), _plain(_said(x, "type")).alias("type"), _said(x, "description").alias("description"))


def _relation(x: Column) -> Column:
    return F.struct(_plain(_said(x, "src")).alias("src"), _plain(_said(x, "tgt")).alias("tgt"), _plain(_said(x, "type")).alias("type"), _said(x, "description").alias("description"))


def _first_of(items: str, key: str) -> Column:
    """The first item of each key, in order; mostly all keys differ."""
    keys = F.col(items)[key]
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.col(items)).otherwise(F.filter(items, lambda x, k: F.array_position(F.col(items)[key], x[key]) == k + 1))


def _with_entities(replies: DataFrame) -> DataFrame:
    """chunk_id, source, data, entities."""
    own = ["chunk_id", "source", "data"]
    said = once(_objects(replies, own[:2]), own, said=F.transform(_items("entities", _ENTITIES), _entity))
    named = F.filter("said", lambda e: (e["name"] != "") & (e["type"] != ""))
    marked = F.transform(named, lambda e: F.struct(entity_id(e["name"], e["type"]).alias("id"), e["name"].alias("name"), e["type"].alias("type"), e["description"].alias("description")))
    return once(once(said, own, marked=marked), own, entities=_first_of("marked", "id"))


def extracted_entities(replies: DataFrame) -> DataFrame:
    """(chunk_id, source, reply) -> chunk_id, source, entities, as ``extracted`` gives them, without the work for relations."""
    return _with_entities(replies).select("chunk_id", "source", "entities")


def extracted(replies: DataFrame) -> DataFrame:
    """(chunk_id, source, reply) -> chunk_id, source, entities, relations; one row per row.

    An entity needs a name and a type, a relation two names and a type; names are compared without case,
    and a relation stays only if both are entities of its chunk (of two of one name, the last). Of one id the first stays.
    A reply without a JSON object, or null, gives none. Numbers stand as text.
    """
    own = ["chunk_id", "source", "entities"]
    single = once(_with_entities(replies), own, said=F.transform(_items("relations", _RELATIONS), _relation))
    # From the end, so that the first name met is the last entity of it.
    ends = once(single, [*own, "said"], names=F.reverse(F.transform("entities", lambda e: F.lower(e["name"]))), ids=F.reverse(F.col("entities")["id"]))
    of_name = lambda name: F.get("ids", (F.array_position("names", F.lower(name)) - 1).cast("int"))
    met = once(ends, own, met=F.transform("said", lambda r: F.struct(of_name(r["src"]).alias("src"), of_name(r["tgt"]).alias("tgt"), r["type"].alias("type"), r["description"].alias("description"))))
    whole = F.filter("met", lambda r: r["src"].isNotNull() & r["tgt"].isNotNull() & (r["type"] != ""))
    key = lambda r: F.substring(F.sha1(F.concat_ws("::", r["src"], r["type"], r["tgt"])), 1, 16)
    keyed = once(met, own, keyed=F.transform(whole, lambda r: F.struct(key(r).alias("id"), r["src"].alias("src"), r["tgt"].alias("tgt"), r["type"].alias("type"), r["description"].alias("description"))))
    return keyed.select(*own, _first_of("keyed", "id").alias("relations"))
