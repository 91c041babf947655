"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of up to ``huge_chars`` characters is encoded at once. A longer one is
encoded in overlapping chunks with offsets, so that memory and the encoder's
superlinear work stay bounded, and neighbours are spliced where both encodings
have a boundary that is *proven stable*: no piece of the vocabulary holds the
two characters around it side by side, so no merge can ever cross it, whatever
stands further left or right. If the overlap holds no such place it is widened
until it does or the text ends.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

MODEL, LIMIT = "piece_bpe_32k.model", 4096
HUGE_CHARS, CHUNK_CHARS, OVERLAP_CHARS = 32_768, 16_384, 128


class PieceCounter:
    """Counts pieces of one model; ``chunk`` and ``overlap`` are in characters."""

    def __init__(self, model: str, huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        from sentencepiece import SentencePieceProcessor

        self.encoder = SentencePieceProcessor(model_file=tokenizer_path(model))
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.joined: set[str] = set()  # pairs of characters that some piece holds side by side
        for i in range(self.encoder.vocab_size()):
            if not (self.encoder.is_byte(i) or self.encoder.is_control(i)):
                piece = self.encoder.id_to_piece(i).replace("▁", " ")
                self.joined.update(map("".join, zip(piece, piece[1:])))

    def stable_before(self, text: str, low: int, high: int) -> int:
        """The last proven boundary in [low, high), or -1."""
        return next((p for p in range(high - 1, low - 1, -1) if text[p - 1 : p + 1] not in self.joined), -1)

    def begins(self, text: str, start: int, end: int) -> list[int]:
        """Where each piece of text[start:end] begins in the text."""
        return [start + b for b, _ in self.encoder.encode(text[start:end], return_type="offset_mapping")["offsets"]]

    def count_huge(self, text: str) -> int:
        total, start, done = 0, 0, 0  # pieces before `done` are counted; the chunk begins at `start`
        while start + self.chunk < len(text):
            end, overlap = start + self.chunk, self.overlap
            while True:
                begins = self.begins(text, start, end)
                if end == len(text):
                    return total + len(begins) - bisect_left(begins, done)
                splice = self.stable_before(text, max(done + 1, end - overlap), end)
                if splice > 0 and splice in begins[bisect_left(begins, splice) :][:1]:
                    follows = max(start + 1, splice - self.overlap)
                    after = self.begins(text, follows, min(len(text), splice + self.overlap))
                    if splice in after[bisect_left(after, splice) :][:1]:
                        break
                overlap *= 2
                end = min(len(text), end + overlap)
            total += bisect_left(begins, splice) - bisect_left(begins, done)
            start, done = follows, splice
        begins = self.begins(text, start, len(text))
        return total + len(begins) - bisect_left(begins, done)

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        small = [i for i, t in enumerate(texts) if t and len(t) <= self.huge]
        for at in range(0, len(small), 256):
            part = small[at : at + 256]
            for i, ids in zip(part, self.encoder.encode([texts[i] for i in part], num_threads=1)):
                out[i] = len(ids)
        for i, t in enumerate(texts):
            if t and len(t) > self.huge:
                out[i] = self.count_huge(t)
        return out


@cache
def _counter(*settings) -> PieceCounter:
    return PieceCounter(*settings)


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit; one row per row.

    A null or empty text has 0 bytes and 0 tokens. Other columns are ignored,
    repeated rows are counted each, an empty table gives no rows.
    """

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(_counter(model, huge, chunk, overlap).counts(texts.tolist()), dtype="int64")

    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
