"""Paragraphs of structured replies, released while the reply still streams in."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_BYTES = 32_768
PARAGRAPH = "struct<text:string,source_ids:array<int>>"
OUT = f"stream_id string, number int, paragraph {PARAGRAPH}, conditions array<{PARAGRAPH}>, status string"
_OPEN = re.compile(r'\s*\{\s*"conditions"\s*:\s*')
_BETWEEN = re.compile(r'\s*,\s*"answer"\s*:\s*\[')
_SPACE = re.compile(r"\s*")
#: What counts in a value, within quotes and outside.
_QUOTED, _BARE = re.compile(r'["\\]'), re.compile(r'["\[\]{}]')


def _paragraph(value: object) -> dict | None:
    """A {text, source_ids} object with nothing else, or None."""
    if not isinstance(value, dict) or value.keys() != {"text", "source_ids"} or not isinstance(value["text"], str):
        return None
    ids = value["source_ids"]
    return value if isinstance(ids, list) and all(type(i) is int for i in ids) else None


class Reply:
    """A reply {"conditions": [...], "answer": [...]} of cited paragraphs, read piece by piece.

    Every character is looked at once: the end of the value in progress is found by its depth and quotes,
    which the reader keeps between pieces, as it does all its fields (``saved``).
    """

    def __init__(self, saved: str | None = None):
        self.rest, self.stage, self.size, self.number, self.failure = "", "open", 0, 0, ""
        self.at, self.depth, self.quoted, self.escaped = 0, 0, False, False
        self.conditions: list[dict] = []
        self.due, self.waiting = 0, {}
        self.__dict__ |= json.loads(saved) if saved else {}

    def saved(self) -> str:
        return json.dumps(self.__dict__)

    def _value(self) -> tuple[object, bool]:
        """The list or object that ``rest`` begins with, once it is complete, and whether it is; what does not begin one fails."""
        if self.at == 0:
            self.rest = self.rest.lstrip()
            if self.rest and self.rest[0] not in "[{":
                raise ValueError("invalid_paragraph" if self.stage == "answer" else "invalid_conditions")
        while self.at < len(self.rest):
            if self.escaped:
                self.at, self.escaped = self.at + 1, False
                continue
            mark = (_QUOTED if self.quoted else _BARE).search(self.rest, self.at)
            if not mark:
                self.at = len(self.rest)
                break
            c, self.at = mark[0], mark.end()
            if self.quoted:
                self.quoted, self.escaped = c != '"', c == "\\"
            elif c == '"':
                self.quoted = True
            elif c in "[{":
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == 0:
                    return json.loads(self.rest[: self.at]), True
        return None, False

    def _taken(self, n: int) -> None:
        self.rest, self.at = self.rest[n:], 0

    def feed(self, piece: str) -> list[dict]:
        """The paragraphs that a piece completes: each once the mark after it has come."""
        if self.failure:
            return []
        self.size += len(piece.encode())
        if self.size > MOST_BYTES:
            self.failure = "generation_buffer_limit"
            return []
        self.rest += piece
        out: list[dict] = []
        try:
            while self._step(out):
                pass
        except json.JSONDecodeError:
            self.failure = "invalid_paragraph"
        except ValueError as e:
            self.failure = str(e)
        return out

    def _step(self, out: list[dict]) -> bool:
        if self.stage in ("open", "between"):
            head = (_OPEN if self.stage == "open" else _BETWEEN).match(self.rest)
            # Of the first head's spaces, more may come; what follows it is a list.
            if not head or (self.stage == "open" and head.end() == len(self.rest)):
                return False
            self._taken(head.end())
            self.stage = "conditions" if self.stage == "open" else "answer"
            return True
        if self.stage == "conditions":
            value, whole = self._value()
            if not whole:
                return False
            found = [_paragraph(x) for x in value] if isinstance(value, list) else [None]
            if None in found:
                raise ValueError("invalid_conditions")
            self.conditions, self.stage = found, "between"
            self._taken(self.at)
            return True
        if self.stage == "answer":
            if self.depth == 0 and self.at > 0:
                value = json.loads(self.rest[: self.at])
            else:
                if self.number == 0 and self.rest.lstrip()[:1] == "]":
                    return False  # an empty answer is never complete
                value, whole = self._value()
                if not whole:
                    return False
            after = _SPACE.match(self.rest, self.at).end()
            if after == len(self.rest):
                return False
            if self.rest[after] not in ",]":
                raise ValueError("invalid_paragraph_delimiter")
            paragraph = _paragraph(value)
            if paragraph is None:
                raise ValueError("invalid_paragraph")
            out.append({"number": self.number, "paragraph": paragraph, "conditions": self.conditions if self.number == 0 else []})
            self.number += 1
            self.stage = "closed" if self.rest[after] == "]" else "answer"
            self._taken(after + 1)
            return True
        return False

    def ended(self, reason: str) -> str:
        """What the reply is after its last piece: complete, or why not."""
        if self.failure:
            return self.failure
        if reason != "stop":
            return "incomplete_generation"
        return "complete" if self.stage == "closed" and self.rest.strip() == "}" else "incomplete_answer"

    def arrived(self, seq: int, piece: str, finish: str | None) -> list[dict]:
        """Feeds the pieces in their order: one that comes early waits, one that came before is left out."""
        if seq >= self.due:
            self.waiting.setdefault(str(seq), [piece, finish])
        out: list[dict] = []
        while str(self.due) in self.waiting:
            piece, finish = self.waiting.pop(str(self.due))
            self.due += 1
            out += self.feed(piece)
            if finish is not None:
                out.append({"number": None, "paragraph": None, "conditions": [], "status": self.ended(finish)})
        return out


def _table(found: list[tuple[str, dict]]) -> pd.DataFrame:
    return pd.DataFrame([(key, x["number"], x["paragraph"], x["conditions"], x.get("status")) for key, x in found], columns=["stream_id", "number", "paragraph", "conditions", "status"])


def _rows(key: str, found: list[dict]) -> pd.DataFrame:
    return _table([(key, x) for x in found])


def _parts(parts: DataFrame, *more: str) -> DataFrame:
    return parts.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.coalesce("piece", F.lit("")).alias("piece"), F.col("finish").cast("string").alias("finish"), *more)


def released_paragraphs(parts: DataFrame, idle: str = "10 minutes", lateness: str = "1 minute") -> DataFrame:
    """A stream of (stream_id, seq from 0, piece, finish on the last piece, at timestamp) -> stream_id, number, paragraph, conditions, status.

    A row a paragraph, as soon as it is complete; the conditions come with the first. The last row of a stream has no number
    but a status: complete, incomplete_answer, incomplete_generation, generation_buffer_limit, invalid_conditions,
    invalid_paragraph or invalid_paragraph_delimiter. Pieces may come late, early or twice. A stream
    that stays idle until the watermark has passed it by ``idle`` ends as incomplete_generation.
    """

    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reply = Reply(state.get[0] if state.exists else None)
        if state.hasTimedOut:
            state.remove()
            yield _rows(key[0], [{"number": None, "paragraph": None, "conditions": [], "status": reply.failure or "incomplete_generation"}])
            return
        found: list[dict] = []
        last = 0
        for batch in batches:
            last = max(last, int(batch["at"].max().timestamp() * 1000))
            for seq, piece, finish in zip(batch["seq"], batch["piece"], batch["finish"]):
                found += reply.arrived(int(seq), piece, None if pd.isna(finish) else finish)
        ended = any("status" in x for x in found)
        if ended:  # what comes after is left out; the mark of the end goes with the idle time
            reply.rest, reply.failure, reply.waiting = "", "ended", {}
        state.update((reply.saved(),))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield _rows(key[0], found)

    def unless_ended(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists and json.loads(state.get[0])["failure"] == "ended":
            if state.hasTimedOut:
                state.remove()
            return iter(())
        return step(key, batches, state)

    rows = _parts(parts.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness), "at")
    return rows.groupBy("stream_id").applyInPandasWithState(unless_ended, OUT, "reply string", "append", GroupStateTimeout.EventTimeTimeout)


def paragraphs(parts: DataFrame) -> DataFrame:
    """The same rows of a table of whole streams; a stream without a finish has no row with a status."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reply, stream = None, None
        for rows in batches:
            found = []
            for at, seq, piece, finish in zip(rows["stream_id"], rows["seq"], rows["piece"], rows["finish"]):
                if reply is None or at != stream:
                    reply, stream = Reply(), at
                found += [(at, x) for x in reply.arrived(int(seq), piece, None if pd.isna(finish) else finish)]
            if found:
                yield _table(found)

    # Pieces of a task's streams, one stream after the other: neither a frame nor a call for each, and no stream is held whole.
    return _parts(parts).repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(read, OUT)
