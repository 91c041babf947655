"""Sessions that stay between batches: when they were touched, their title, and their rolling history."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

THRESHOLD, KEEP, LINE_CHARS, DIALOG_CHARS, TITLE_CHARS = 10, 6, 200, 3000, 50
#: Names of roles in a dialog.
NAMES = {"user": "用户", "assistant": "助手"}
OUT = "session_id string, created_at double, last_active double, title string, messages long, dialog string, recent array<string>, expired boolean"


class Session:
    """What is kept of a session: bounded, however long it lasts.

    Of the messages, the last ``THRESHOLD`` as they are, and of those before them the first ``DIALOG_CHARS`` of the
    dialog, one "role: begin of the text" a line.
    """

    def __init__(self, saved: str | None = None):
        self.created = self.last = None
        self.title, self.messages, self.before = "", 0, ""
        self.held: list[list[str]] = []
        self.__dict__ |= json.loads(saved) if saved else {}

    def saved(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def _line(role: str, text: str) -> str:
        return f"{NAMES.get(role, role)}: {text[:LINE_CHARS]}"

    def _with(self, before: str, role: str, text: str) -> str:
        return before if len(before) >= DIALOG_CHARS else (before + "\n" * bool(before) + self._line(role, text))[:DIALOG_CHARS]

    def message(self, at: float, role: str, text: str) -> None:
        self.created = at if self.created is None else min(self.created, at)
        self.last = at if self.last is None else max(self.last, at)
        if not self.title and role == "user":
            self.title = text.replace("\n", " ")[:TITLE_CHARS]
        self.messages += 1
        self.held.append([role, text])
        if len(self.held) > THRESHOLD:
            self.before = self._with(self.before, *self.held.pop(0))

    def row(self, key: str, expired: bool = False) -> tuple:
        """Up to THRESHOLD messages all are recent; beyond, the last KEEP, and the dialog holds what came before."""
        dialog, recent = "", self.held
        if self.messages > THRESHOLD:
            dialog, recent = self.before, self.held[-KEEP:]
            for message in self.held[:-KEEP]:
                dialog = self._with(dialog, *message)
        return key, self.created, self.last, self.title, self.messages, dialog, [text for _, text in recent], expired


_NAMES = ["session_id", "created_at", "last_active", "title", "messages", "dialog", "recent", "expired"]


def _messages(messages: DataFrame, *more: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return messages.select(F.col("session_id").cast("string").alias("session_id"), F.col("at").cast("timestamp").cast("double").alias("second"), text("role").alias("role"), text("text").alias("text"), *more)


def live_sessions(messages: DataFrame, idle: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """A stream of (session_id, at timestamp, role, text) -> the state of each session that a batch touched, in update mode.

    A session that stays idle until the watermark has passed it by ``idle`` comes once more as expired, and is
    forgotten. A batch is read by ``at``; what comes in a later batch counts as later.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = Session(state.get[0] if state.exists else None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([session.row(key[0], True)], columns=_NAMES)
            return
        for row in pd.concat(list(batches)).sort_values("second", kind="stable")[["second", "role", "text"]].itertuples(index=False):
            session.message(*row)
        state.update((session.saved(),))
        state.setTimeoutTimestamp(max(int(session.last * 1000), state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame([session.row(key[0])], columns=_NAMES)

    rows = _messages(messages.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness), "at")
    return rows.groupBy("session_id").applyInPandasWithState(step, OUT, "session string", "update", GroupStateTimeout.EventTimeTimeout)


def session_states(messages: DataFrame) -> DataFrame:
    """The last state of each session of a table (session_id, at, role, text); messages at one time go by role and text.

    Rows stream through their session's task one by one, so a session of any length takes bounded memory.
    """

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, session = None, None
        for batch in batches:
            done = []
            for name, rows in groupby(batch[["session_id", "second", "role", "text"]].itertuples(index=False, name=None), lambda r: r[0]):
                if session is None or name != key:
                    if session is not None:
                        done.append(session.row(key))
                    key, session = name, Session()
                for _, *message in rows:
                    session.message(*message)
            if done:
                yield pd.DataFrame(done, columns=_NAMES)
        if session is not None:
            yield pd.DataFrame([session.row(key)], columns=_NAMES)

    rows = _messages(messages).where("session_id is not null")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "second", "role", "text").mapInPandas(states, OUT)
