"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3
letters; a space marks a word's begin or end) in order of frequency. A document
gets the language whose profile is nearest to its own by out-of-place distance:
for each of the document's most frequent n-grams the difference of the two
ranks, or the profile's length where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UND = "und"
#: n-grams in a profile; most labelled documents of each language that a profile is fitted on; most languages.
PROFILE, TRAIN_DOCS, MOST_LANGS = 400, 3000, 1000
#: Characters of a text that are read at a time.
PIECE = 1_000_000


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, packed 21 bits a character, and their counts.

    A long text is read in pieces of ``size`` characters, so that memory is
    bounded. The two places before a piece and whether a letter came last are
    carried over, so the counts are those of the whole text.
    """
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    carried, after_letter = np.array([32], dtype=np.int64), False  # a space before the text
    for at in range(0, max(1, len(text)), size):
        last = at + size >= len(text)
        # A sigma's lower case depends on what follows, which a piece may not hold; both forms count as one.
        piece = text[at : at + size].lower().replace("\u03c2", "\u03c3") + " " * last
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[points]
        # One space between words: a place stays if it or the one before it is a letter.
        new = np.where(letter, points, 32).astype(np.int64)[letter | np.r_[after_letter, letter[:-1]]]
        c = np.r_[carried, new]
        word, fresh = c != 32, len(new)
        pairs, pair_ok = (c[:-1] << 21) | c[1:], word[:-1] | word[1:]
        triples, middle = (pairs[:-1] << 21) | c[2:], word[1:-1]
        fresh_pairs, fresh_triples = min(fresh, len(pairs)), min(fresh, len(triples))
        found = [new[new != 32], pairs[len(pairs) - fresh_pairs :][pair_ok[len(pairs) - fresh_pairs :]], triples[len(triples) - fresh_triples :][middle[len(triples) - fresh_triples :]]]
        more = np.concatenate(found)
        more.sort()
        starts = np.flatnonzero(np.r_[True, more[1:] != more[:-1]]) if len(more) else np.empty(0, np.int64)
        more, n = more[starts], np.diff(np.r_[starts, len(more)])
        if len(keys):
            keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
        else:
            keys, counts = more, n
        carried, after_letter = c[-2:], bool(letter[-1]) if len(letter) else after_letter
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by n-gram."""
    if len(keys) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:top]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], length: int):
        self.names, self.length = sorted(profiles), length
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], dtype=np.int64))
        self.ranks = np.full((len(self.names), len(self.keys) + 1), -1, dtype=np.int64)  # the last column: in no profile
        for row, name in enumerate(self.names):
            self.ranks[row, np.searchsorted(self.keys, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest profile, ties by name, and 1 - distance / largest distance."""
        keys, counts = grams(text) if text else (np.empty(0, np.int64),) * 2
        if not len(keys) or not self.names:
            return UND, 0.0
        own = ranked(keys, counts, self.length)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = self.ranks[:, np.where(self.keys[at] == own, at, len(self.keys))]
        far = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(own)))).sum(1)
        best = int(far.argmin())
        return self.names[best], float(1 - far[best] / (self.length * len(own)))


def learned_profiles(labelled: DataFrame, length: int = PROFILE, train_docs: int = TRAIN_DOCS, most_langs: int = MOST_LANGS) -> dict[str, list[int]]:
    """(doc_id, text, lang) -> each language's profile.

    It is fitted on at most about ``train_docs`` documents of a language, those
    with the smallest hashes of doc_id, so that its cost does not grow with the
    corpus; the n-grams are counted in the tasks and summed by Spark. Rows whose
    lang or text is null are left out, repeated rows count each, no rows give no
    profile; other columns are ignored. All profiles are sent to every task, so more than
    ``most_langs`` languages are refused with a ValueError, none is left out.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs + 1).collect()
    if not sizes:
        return {}
    if len(sizes) > most_langs:
        raise ValueError(f"lang holds more than {most_langs} languages; raise most_langs if that is meant")
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_docs / r["n"]))))
    draw = F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                together, chars = [], 0
                for k, text in enumerate(texts, 1):
                    together.append(text)
                    chars += len(text)
                    if chars >= PIECE or k == len(texts):
                        keys, counts = grams(" ".join(together))
                        yield pd.DataFrame({"lang": lang, "gram": keys, "n": counts})
                        together, chars = [], 0

    drawn = labelled.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    counted = drawn.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    found: dict[str, list] = {}
    for r in top.select("lang", "gram", "rank").collect():  # at most most_langs x length rows
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: [g for _, g in sorted(rows)] for lang, rows in found.items()}


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _predictor(profiles: dict[str, list[int]], length: int):
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = _model(length, tuple((k, tuple(v)) for k, v in profiles.items()))
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


@cache
def _model(length: int, profiles: tuple) -> Profiles:
    return Profiles(dict(profiles), length)


def predictions(docs: DataFrame, length: int = PROFILE, train_docs: int = TRAIN_DOCS):
    """The column function text -> (lang_pred, score) learned from docs (doc_id, text, lang).

    Learned from rows with a known language whose crc32(doc_id) mod 5 is not 0;
    rows without doc_id are never learned from.
    """
    known = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "text", "lang")
    return _predictor(learned_profiles(known, length, train_docs), length)


def language_id(docs: DataFrame, length: int = PROFILE, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, held_out, lang_pred, score; one row per row.

    ``und`` with score 0 where the text is null, empty or has no letter, or where
    no language could be learned. lang is only a label. Rows without doc_id are
    predicted but not learned from, and not held out. Repeated rows are each
    predicted; other columns are ignored; an empty table gives no rows.
    """
    found = docs.select("doc_id", predictions(docs, length, train_docs)("text").alias("found"))
    return found.select("doc_id", held_out().alias("held_out"), "found.lang_pred", "found.score")


def drop_unidentified(docs: DataFrame, **settings) -> DataFrame:
    """The documents in which a language was found; columns as they are, whatever their names.

    Documents whose text is null, empty or without a letter go; repeated rows and
    rows without doc_id stay each; an empty table stays empty. If no language
    could be learned, no document stays.
    """
    return docs.where(predictions(docs, **settings)("text")["lang_pred"] != UND)
