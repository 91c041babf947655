"""Conversation repair: the lightest derivation of a well-formed conversation, by Knuth's agenda.

Items are weighted statements "the edits so far use the first i rows and leave the
roles in state q". A deduction takes such an item and one edit (of the next row, or
an insertion) and concludes the item after it; its weight is the pair (cost,
audit): costs add up, the audit is written on. That function is monotone and
never below its arguments (superior), so items popped from the agenda in the order of
(cost, audit) are final, and the goal's first pop is the cheapest repair with the
least audit.

A conversation may be as long as the table. Its rows are placed by sums over ranges
and dealt out in blocks of equal size, whatever conversation they belong to. A block
that holds a whole conversation runs the agenda to its goal; one that holds a part runs
it from each state to each state, and the parts' items are deduced together, some
dozens at a time, by the same agenda. Only the final digest, a chain over the whole
text by definition, reads a conversation in one task, as a stream of rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, running

BLANKS = " \t\n\v\f\r"
BLOCK_ROWS, FAN = 512, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the roles so far: none, only the system row, a user row at the end, an answered pair at the end.
NONE, SYSTEM, ASKED, ANSWERED = range(4)
STATES, GOALS = (NONE, SYSTEM, ASKED, ANSWERED), (NONE, ANSWERED)
#: The role that may come next in a state, and the state after it.
NEXT = {NONE: ("u", ASKED), SYSTEM: ("u", ASKED), ASKED: ("a", ANSWERED), ANSWERED: ("u", ASKED)}
ROLES = {"u": "user", "a": "assistant"}
#: Adjacent initials that are in order.
LEGAL = ("su", "ua", "au")

Weight = tuple[int, str]
Edges = list[tuple[int, int, str]]


def lightest(n: int, edits: Callable[[int, int], Edges], start: int, goals: Iterable[int] | None = None) -> dict[int, Weight]:
    """The least (cost, audit) of the items (n, state), from the axiom (0, start).

    ``edits(i, q)`` lists the edits open to the item (i, q) as (rows used, state after, cost, letters).
    With goals, it ends when the first of them is popped; else when all items are final.
    """
    goals = None if goals is None else set(goals)
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    best: dict[tuple[int, int], Weight] = {(0, start): (0, "")}
    final: set[tuple[int, int]] = set()
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if goals is not None and i == n and q in goals:
            return {q: (cost, audit)}
        for used, after, more, letters in edits(i, q):
            item, weight = (i + used, after), (cost + more, audit + letters)
            if item not in final and (item not in best or weight < best[item]):
                best[item] = weight
                heapq.heappush(agenda, (*weight, *item))
    return {q: best[n, q] for q in STATES if (n, q) in final}


def row_edits(rows: list[tuple[str, str]]) -> Callable[[int, int], Edges]:
    """The edits over rows of (initial of the role, fault)."""

    def edits(i: int, q: int) -> Edges:
        role, after = NEXT[q]
        found = [(0, after, INSERT, "I")]
        if i < len(rows):
            initial, fault = rows[i]
            found.append((1, q, DELETE, "D"))
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED if fault == "truncated" else 0
                if initial == role:
                    found.append((1, after, KEEP + extra, "K"))
                else:
                    found.append((1, after, REROLE + extra, "R"))
                if initial == "s" and q == NONE:
                    found.append((1, SYSTEM, KEEP + extra, "K"))
        return found

    return edits


def part_edits(parts: list[dict[int, dict[int, Weight]]]) -> Callable[[int, int], Edges]:
    """The edits over whole parts of a conversation, each given by its items from state to state."""
    return lambda i, q: [(1, after, *weight) for after, weight in parts[i].get(q, {}).items()] if i < len(parts) else []


def repair(rows: list[tuple[str, str]]) -> Weight:
    """The cheapest cost and its least audit for rows of (initial, fault)."""
    return next(iter(lightest(len(rows), row_edits(rows), NONE, GOALS).values()))


# Damage ----------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the same after damage, with ``gone``; a dropped row stays, marked as gone.

    crc32 of ``conv_id:turn`` mod 20 decides: 0 drops, 1 empties the text, 2 takes its ``.!?``, 3 repeats the
    row, 4 makes it the user's. Nulls (in the key, role and text) are one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = conversations.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (draw == 0).alias("gone"), F.explode(F.sequence(F.lit(0), (draw == 3).cast("int"))).alias("copy"))
    return rows.drop("copy")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))


# Parts of conversations --------------------------------------------------------------------------------------------

#: What is known of a part of a conversation: counts, its ends, and its items [from, to, cost, audit].
_PART = "first_place long, last_place long, rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, turns long, first_turn long, last_turn long, items array<struct<begin:int,end:int,cost:long,audit:string>>"


def _runs(batches: Iterator[pa.RecordBatch], key: Callable[[dict], object]) -> Iterator[list[dict]]:
    """Rows with one key, from batches that are sorted by it."""
    rows = (dict(zip(batch.schema.names, values)) for batch in batches for values in zip(*(c.to_pylist() for c in batch.columns)))
    for _, run in groupby(rows, key):
        yield list(run)


def _whole(items: dict[int, dict[int, Weight]]) -> list[dict]:
    return [{"begin": q, "end": r, "cost": c, "audit": a} for q, found in items.items() for r, (c, a) in found.items()]


def _part(conv: list[dict], opens: bool, closes: bool) -> dict:
    """The part that consecutive rows of one conversation are; whether they are known to be its first and its last ones."""
    rows = [r for r in conv if not r["gone"]]
    faults = [r["fault"] for r in rows]
    initials = [r["initial"] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    steps = row_edits(list(zip(initials, faults)))
    items = {q: lightest(len(rows), steps, q, GOALS if closes and opens else None) for q in ((NONE,) if opens else STATES)}
    return {
        "conv_id": conv[0]["conv_id"], "first_place": conv[0]["place"], "last_place": conv[-1]["place"], "rows": len(rows),
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "first_initial": initials[0] if rows else None, "last_initial": initials[-1] if rows else None,
        "turns": len(set(turns)), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "items": _whole(items),
    }


def _joined(parts: list[dict]) -> dict:
    """One part of consecutive ones."""
    items = [{q: {x["end"]: (x["cost"], x["audit"]) for x in p["items"] if x["begin"] == q} for q in STATES} for p in parts]
    made = {q: lightest(len(parts), part_edits(items), q) for q in STATES if items[0][q]}
    out = parts[0] | {"last_place": parts[-1]["last_place"], "items": _whole(made)}
    for p in parts[1:]:
        out |= {k: out[k] + p[k] for k in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")}
        if out["last_initial"] is not None and p["first_initial"] is not None:
            out["illegal"] += out["last_initial"] + p["first_initial"] not in LEGAL
        if p["first_turn"] is not None and p["first_turn"] == out["last_turn"]:
            out["turns"] -= 1
        for end, other in (("first_initial", out["first_initial"]), ("first_turn", out["first_turn"])):
            out[end] = p[end] if other is None else other
        for end in ("last_initial", "last_turn"):
            out[end] = out[end] if p[end] is None else p[end]
    return out


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(kind: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], kind).schema)


def conversation_parts(rows: DataFrame, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """(conv_id, turn, gone, initial, fault, place) -> one row per conversation: its counts and its items from NONE to a goal.

    place is the row's place among all rows, by conversation and then in its order.
    """
    kind = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_PART}"
    schema = _arrow(kind, rows.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, lambda r: r["place"] // block_rows):
            convs = [list(run) for _, run in groupby(block, lambda r: r["conv_id"])]
            yield _batch([_part(c, k > 0, 0 < k < len(convs) - 1) for k, c in enumerate(convs)], schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _runs(batches, lambda r: (r["conv_id"], r["group"])):
            yield _batch([{k: v for k, v in _joined(parts).items() if k != "group"}], schema)

    dealt = rows.repartition((F.col("place") - F.col("place") % block_rows).alias("block")).sortWithinPartitions("place")
    parts, width = durable(dealt.mapInArrow(fold, kind)), block_rows
    whole = None
    while True:
        # A part without a neighbour of its conversation is done.
        counts = parts.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
        several = durable(parts.join(counts, parts["conv_id"].eqNullSafe(counts["c"]), "left_semi"))
        single = parts.join(counts, parts["conv_id"].eqNullSafe(counts["c"]), "left_anti")
        whole = single if whole is None else whole.unionByName(single)
        if not several.limit(1).collect():
            return whole
        width *= fan
        grouped = several.withColumn("group", F.floor(F.col("first_place") / width)).repartition("conv_id", "group").sortWithinPartitions("conv_id", "group", "first_place")
        parts = durable(grouped.mapInArrow(join, kind))


# The whole job -------------------------------------------------------------------------------------------------------


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of damaged rows -> conv_id, turn, gone, initial, fault, place.

    fault is the row's first of blank, duplicate, truncated, or null.
    """
    facts = rows.select(
        "conv_id", "turn", "gone", F.substring("role", 1, 1).alias("initial"), _digest().alias("row_digest"),
        (~F.col("text").rlike(WORD)).alias("blank"), (~F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).isin(*".!?")).alias("cut_off"), F.monotonically_increasing_id().alias("spread"),
    )
    # Rows alike in all of these may change places; the last one lets them spread over ranges.
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("row_digest").asc(), F.col("spread").asc()]
    placed = durable(running(facts, order, place=F.lit(1).cast("long")))
    first = placed.where("not gone").groupBy(F.col("conv_id").alias("c"), F.col("row_digest").alias("d")).agg(F.min("place").alias("first"))
    marked = placed.join(first, placed["conv_id"].eqNullSafe(first["c"]) & (placed["row_digest"] == first["d"]), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(F.col("cut_off"), "truncated")
    return marked.select("conv_id", "turn", "gone", "initial", fault.alias("fault"), "place")


def repaired(conversations: DataFrame, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    One row per conv_id, nulls being one conversation. Rows are damaged first (``damaged``), then taken by turn, nulls
    first; rows of one turn go by a digest of role and text, so reruns agree. Rows alike in all are each a row, the later ones
    duplicates. Roles count by their first character; other roles than system, user and assistant are never in order.
    A conversation without rows after damage has zeros and an empty audit. Other columns are ignored; an empty table
    gives no rows. turn is an integer. The audit is one value of the result and must fit a row.
    """
    rows = damaged(conversations)
    parts = conversation_parts(faults(rows), block_rows, fan)
    goal = F.array_min(F.transform(F.filter("items", lambda x: (x["begin"] == NONE) & x["end"].isin(*GOALS)), lambda x: F.struct(x["cost"], x["audit"])))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    heads = durable(parts.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", goal.alias("goal")).select("*", "goal.cost", "goal.audit").drop("goal"))
    return _with_text_digest(heads, rows)


def _with_text_digest(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """heads with the sha256 of the repaired rows, which stream by behind their conversation's audit."""
    names = [c for c in heads.columns if c != "conv_id"]
    kind = f"conv_id {heads.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} {heads.schema[c].dataType.simpleString()}" for c in names) + ", repaired_sha256 string"
    schema = _arrow(kind, heads.sparkSession)
    nothing = F.lit(None)
    top = heads.select("conv_id", F.lit(0).alias("kind"), nothing.cast("long").alias("turn"), nothing.cast("binary").alias("row_digest"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), *names)
    body = rows.where("not gone").select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), _digest().alias("row_digest"), "role", "text", *(nothing.cast(heads.schema[c].dataType).alias(c) for c in names))
    dealt = top.unionByName(body).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "row_digest")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, writer = None, None
        for batch in batches:
            done = []
            for kind, role, text, *values in zip(*(batch.column(c).to_pylist() for c in ("kind", "role", "text", "conv_id", *names))):
                if kind == 0:
                    if head is not None:
                        done.append(head | {"repaired_sha256": writer.ended()})
                    head = dict(zip(("conv_id", *names), values))
                    writer = _Writer(head["audit"])
                else:
                    writer.row(role, text)
            if done:
                yield _batch(done, schema)
        if head is not None:
            yield _batch([head | {"repaired_sha256": writer.ended()}], schema)

    return dealt.select("conv_id", "kind", "role", "text", *names).mapInArrow(digests, kind)


class _Writer:
    """The digest of a repaired conversation; its rows come one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines, self.digest = audit, 0, NONE, 0, sha256()

    def line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def due(self) -> str:
        role, self.state = NEXT[self.state]
        return ROLES[role]

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.line(self.due(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            self.line(self.due(), text)
        elif edit == "K":
            if role[:1] == "s" and self.state == NONE:
                self.state = SYSTEM
            else:
                self.due()
            self.line(role, text)

    def ended(self) -> str:
        self.inserted()
        return self.digest.hexdigest()
