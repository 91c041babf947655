"""Splitting long texts where they change their subject, or by a list of separators.

Every text is split by itself in its own task: no shuffle, memory of few texts and
their pieces. Small texts stay whole.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..functions.text import parent_id
from .batches import parts

KEEP_CHARS, CHUNK, OVERLAP = 3840, 900, 120
KEEP_TOKENS, CHARS_A_TOKEN = 1200, 3.2
PERCENTILE, DIMENSIONS = 95.0, 64
#: Where a text may be cut, the first that occurs in it before all others; the last is every character.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ".", "!", "?", "；", ";", "，", ",", " ", "")
_SENTENCE_END = re.compile(r"(?<=[.?!])[\x20\x09-\x0D]+")
_TERM = re.compile(r"[a-z0-9_]{2,}|[一-鿿]+")

Measure = Callable[[str], int]


def tokens_of(text: str) -> int:
    """The estimate of a text's tokens by its length; at least one."""
    return max(1, int(len(text) / CHARS_A_TOKEN))


# By separators -------------------------------------------------------------------------------------------------------


def _packed(fragments: list[str], size: int, overlap: int, measure: Measure) -> Iterator[str]:
    """Neighbouring fragments joined up to a size; a chunk begins with the end of the one before, up to an overlap."""
    held: deque[tuple[str, int]] = deque()
    total = 0
    for fragment in fragments:
        n = measure(fragment)
        if held and total + n > size:
            yield "".join(f for f, _ in held)
            while held and (total > overlap or total + n > size):
                total -= held.popleft()[1]
        held.append((fragment, n))
        total += n
    if held:
        yield "".join(f for f, _ in held)


def recursive_pieces(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, measure: Measure = len) -> list[str]:
    """The chunks of a text: cut before each occurrence of the first separator that it holds, what is still too large by
    the later ones, and neighbours packed up to ``size``. Chunks are stripped; empty ones go.

    A fragment of ``size`` or more is packed with none around it. One that no separator is left for stays larger.
    """

    def chunks(part: str, left: tuple[str, ...]) -> Iterator[str]:
        level = next((k for k, s in enumerate(left) if not s or s in part), len(left) - 1)
        first, *others = part.split(left[level]) if left[level] else ["", *part]
        run: list[str] = []
        for fragment in filter(None, [first, *(left[level] + o for o in others)]):
            if measure(fragment) < size:
                run.append(fragment)
                continue
            yield from _packed(run, size, overlap, measure)
            run = []
            if level + 1 < len(left):
                yield from chunks(fragment, left[level + 1 :])
            else:
                yield fragment
        yield from _packed(run, size, overlap, measure)

    return [c for c in (c.strip() for c in chunks(text, separators)) if c] if text else []


# By subject ----------------------------------------------------------------------------------------------------------


def sentences(text: str) -> list[str]:
    """Cut after . ? ! before white space, which goes."""
    return [s for s in _SENTENCE_END.split(text) if s]


def hashed_vectors(parts: list[str]) -> np.ndarray:
    """Counts of each part's terms by the first byte of their md5, mod ``DIMENSIONS``."""
    out = np.zeros((len(parts), DIMENSIONS))
    bucket: dict[str, int] = {}
    for k, part in enumerate(parts):
        for term in _TERM.findall(part.lower()):
            if term not in bucket:
                bucket[term] = md5(term.encode()).digest()[0] % DIMENSIONS
            out[k, bucket[term]] += 1
    return out


def breakpoints(vectors: np.ndarray, percentile: float = PERCENTILE) -> np.ndarray:
    """Of each part but the last, whether the next one begins a new segment.

    A part counts with its two neighbours. The cosine distance of two that follow each other
    must be above the percentile of all of the text's; a part without terms is 0 from another such, else 1.
    """
    if len(vectors) < 2:
        return np.zeros(0, dtype=bool)
    around = vectors.copy()
    around[1:] += vectors[:-1]
    around[:-1] += vectors[1:]
    dot = np.einsum("ij,ij->i", around[:-1], around[1:])
    square = np.einsum("ij,ij->i", around, around)
    both, neither = square[:-1] * square[1:] > 0, square[:-1] + square[1:] == 0
    cosine = np.where(both, dot / np.sqrt(np.where(both, square[:-1] * square[1:], 1)), neither)
    far = np.round(1 - cosine, 9)
    return far > np.percentile(far, percentile) + 1e-9


def semantic_pieces(text: str, percentile: float = PERCENTILE, vectors: Callable[[list[str]], np.ndarray] = hashed_vectors) -> list[str]:
    """The segments of a text, their sentences joined by a space."""
    parts = sentences(text)
    if not parts:
        return []
    cuts = [0, *(np.flatnonzero(breakpoints(vectors(parts), percentile)) + 1).tolist(), len(parts)]
    return [" ".join(parts[a:b]) for a, b in zip(cuts, cuts[1:])]


# Over tables ---------------------------------------------------------------------------------------------------------


def _cut(rows: DataFrame, split: Callable[[str], list[str]]) -> DataFrame:
    """rows with a text -> their other columns, place, chunk, pieces (of the whole text): few texts and their pieces at a time."""
    names = [c for c in rows.columns if c != "text"]
    schema = StructType([*(rows.schema[c] for c in names)]).add("place", IntegerType()).add("chunk", StringType()).add("pieces", IntegerType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            found = [split(t) if t else [] for t in part.column("text").to_pylist()]
            sizes = np.array([len(f) for f in found], dtype=np.int32)
            row = np.repeat(np.arange(len(found)), sizes)
            place = np.arange(len(row), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
            held = [part.column(c).take(pa.array(row)) for c in names]
            yield pa.RecordBatch.from_arrays([*held, pa.array(place), pa.array([c for f in found for c in f], pa.string()), pa.array(sizes[row])], [*names, "place", "chunk", "pieces"])

    return rows.mapInArrow(cut, schema)


def recursive_chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, measure: Measure = len) -> DataFrame:
    """(doc_id, text) -> doc_id, place, chunk. Null and empty texts give no rows; blank ones neither."""
    return _cut(docs.select("doc_id", "text"), lambda t: recursive_pieces(t, size, overlap, separators, measure)).drop("pieces")


def semantic_chunks(docs: DataFrame, percentile: float = PERCENTILE, vectors: Callable[[list[str]], np.ndarray] = hashed_vectors) -> DataFrame:
    """(doc_id, text) -> doc_id, place, chunk. Null and empty texts give no rows."""
    return _cut(docs.select("doc_id", "text"), lambda t: semantic_pieces(t, percentile, vectors)).drop("pieces")


def sized_chunks(docs: DataFrame, keep: int = KEEP_CHARS, measure: Measure = len, size: int = CHUNK, overlap: int = OVERLAP, by_subject: bool = True) -> DataFrame:
    """(doc_id, source, text) -> doc_id, parent_id, place, chunk, whole.

    A text that measures up to ``keep`` stays as it is; a longer one is cut by subject, or by separators
    if that is not asked for or finds no sentence; one that nothing can cut stays whole. All chunks of a
    text carry its parent id: source and the first eight hex digits of its sha1 as a number; none without a source.
    """

    def split(text: str) -> list[str]:
        if measure(text) <= keep:
            return [text]
        pieces = semantic_pieces(text) if by_subject else []
        return pieces or recursive_pieces(text, size, overlap, SEPARATORS, measure) or [text]

    section = F.conv(F.substring(F.sha1("text"), 1, 8), 16, 10)
    parent = F.when(F.coalesce("source", F.lit("")) != "", parent_id(F.col("source"), section))
    rows = _cut(docs.where(F.length("text") > 0).select("doc_id", parent.alias("parent_id"), "text"), split)
    return rows.select("doc_id", "parent_id", "place", "chunk", (F.col("pieces") == 1).alias("whole"))
