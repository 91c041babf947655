"""What may be sent of a row's metadata: bounded, finite, without vectors, all through its depth."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of vectors, and the most levels, items of a list or an object, and characters of a string.
DROPPED = frozenset(["_late_chunk_dense", "embedding", "dense", "sparse", "vector"])
LEVELS, ITEMS, CHARS = 6, 64, 4000
LEAST, MOST = -(2**63), 2**64 - 1
_NOTHING = ...  # pickled as itself


def _single(value: Any) -> tuple[Any, bool]:
    """A null, truth value, number or string as it may be sent, and whether something of it was lost."""
    if isinstance(value, str):
        return value[:CHARS], len(value) > CHARS
    fits = value is None or isinstance(value, bool) or (math.isfinite(value) if isinstance(value, float) else LEAST <= value <= MOST)
    return (value, False) if fits else (_NOTHING, True)


def bounded(value: Any, level: int = 0) -> tuple[Any, bool]:
    """A JSON value as it may be sent (``_NOTHING`` if none of it may), and whether something of it was lost.

    Of lists and objects the first ``ITEMS`` stay; below ``LEVELS`` nothing does but single values. An object of which
    nothing is left goes as a whole.
    """
    if not isinstance(value, (list, dict)):
        return _single(value)
    if level >= LEVELS:
        return _NOTHING, True
    named = isinstance(value, dict)
    pairs = list(value.items() if named else enumerate(value))
    kept: list[tuple] = []
    lost = len(pairs) > ITEMS
    for key, item in pairs[:ITEMS]:
        safe, less = (_NOTHING, True) if named and key in DROPPED else bounded(item, level + 1)
        lost |= less
        if safe is not _NOTHING:
            kept.append((key, safe))
    if named and pairs and not kept and lost:
        return _NOTHING, True
    return (dict(kept) if named else [item for _, item in kept]), lost


def sendable(value: Any, level: int = 0) -> bool:
    """Whether a JSON value may be sent just as it is."""
    if not isinstance(value, (list, dict)):
        return not _single(value)[1]
    if level >= LEVELS or len(value) > ITEMS:
        return False
    if isinstance(value, dict):
        return not DROPPED & value.keys() and all(sendable(x, level + 1) for x in value.values())
    return all(sendable(x, level + 1) for x in value)


def _parsed(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return _NOTHING


def wire_metadata(metadata: Column | str) -> Column:
    """A JSON object as struct<metadata: string, degraded: boolean>: what may be sent of it.

    Null stands for an object without keys; what is no JSON object, and one of which nothing may be sent, gives {} and is degraded.
    """

    @F.pandas_udf("metadata string, degraded boolean")
    def safe(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            value = {} if text is None else _parsed(text)
            kept, lost = bounded(value) if isinstance(value, dict) else (_NOTHING, True)
            out.append(("{}", True) if kept is _NOTHING else (json.dumps(kept, ensure_ascii=False, separators=(",", ":")), lost))
        return pd.DataFrame(out, columns=["metadata", "degraded"])

    return safe(metadata)


def wire_safe_json(value: Column | str) -> Column:
    """Whether a JSON text holds a value that may be sent as it is; null is one, what is no JSON is not."""

    @F.pandas_udf("boolean")
    def safe(texts: pd.Series) -> pd.Series:
        return pd.Series([text is None or (_parsed(text) is not _NOTHING and sendable(_parsed(text))) for text in texts], dtype=bool)

    return safe(value)
