"""Lexical index and BM25 over batches of queries.

Queries are the stated set: they go out in blocks. For so many blocks at a time the documents
are read twice where they lie, once for the statistics of the blocks' terms and
once for the scores; only k rows a query leave a task, so neither texts nor
(query, document) pairs are ever shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .batches import parts

K1, B = 1.5, 0.75
#: Queries of a block, cells of a block of scores, and blocks that one reading of the documents serves.
BLOCK, CELLS, TOGETHER = 256, 1 << 22, 16
#: The rule of ``functions.text.tokens`` on lower-case texts.
_TOKEN = re.compile("[a-z0-9_A-Z]{2,}|[一-鿿]+")
#: The rule of ``functions.text.terms`` on lower-case texts.
_TERM = re.compile("[a-z0-9_]+|[一-鿿]")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf, dl): one row per term of a document, counted before any shuffle by text."""
    split = docs.select(F.col(key).alias("doc_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    each = split.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.size(tokens(F.coalesce(F.col(text), F.lit("")))).alias("dl"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, idf) of the whole corpus."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def updated_stats(whole: DataFrame, gone: DataFrame, added: DataFrame) -> DataFrame:
    """(term, df) of a corpus after documents went and others came: only their terms are counted anew; terms in no document go."""
    counts = whole.select("term", "df").unionByName(gone.select("term", (-F.col("df")).alias("df"))).unionByName(added.select("term", "df"))
    return counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


class Block:
    """Some of the queries and the places of their terms; ``asked`` says how often a query names a term, once at most with ``whole``."""

    def __init__(self, queries: list[tuple[int, str]], token: re.Pattern = _TOKEN, whole: bool = False):
        self.ids = np.array([q for q, _ in queries], dtype=np.int64)
        self.texts = [(t or "").lower() for _, t in queries] if whole else []
        found = [Counter(token.findall((t or "").lower())) for _, t in queries]
        found = [Counter(set(c)) for c in found] if whole else found
        self.terms = sorted({t for c in found for t in c})
        place = {t: k for k, t in enumerate(self.terms)}
        self.named = np.array([(place[t], j, n) for j, c in enumerate(found) for t, n in c.items()], dtype=np.int64).reshape(-1, 3)

    def asked(self) -> np.ndarray:
        """Terms x queries."""
        out = np.zeros((len(self.terms), len(self.ids)))
        out[self.named[:, 0], self.named[:, 1]] = self.named[:, 2]
        return out

    def add_whole(self, scores: np.ndarray, texts: list[str | None]) -> None:
        """One more for each lower-case text that holds a query as it is.

        Only the first and the last term of a query can be parts of longer words there, so such a text has all of its terms but two.
        """
        least = np.maximum(1, np.bincount(self.named[:, 1], minlength=len(self.ids)) - 2)
        for d, q in zip(*np.nonzero(scores >= least)):
            scores[d, q] += self.texts[q] in texts[d]


class Blocks:
    """Blocks that one reading of the documents serves, and the places of all their terms."""

    def __init__(self, blocks: list[Block], token: re.Pattern = _TOKEN):
        self.blocks, self.token = blocks, token
        self.place = {t: k for k, t in enumerate(sorted({t for b in blocks for t in b.terms}))}
        #: Of each block, its own place of a term, -1 if it has none.
        self.own = [np.full(len(self.place), -1, dtype=np.int64) for _ in blocks]
        for own, b in zip(self.own, blocks):
            own[[self.place[t] for t in b.terms]] = np.arange(len(b.terms))

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: document and term of each posting with a known term, its count, and the documents' lengths."""
        place, sizes, terms, lengths = self.place, [], [], []
        for text in texts:
            found = self.token.findall((text or "").lower())
            lengths.append(len(found))
            known = [place[t] for t in found if t in place]
            terms += known
            sizes.append(len(known))
        docs = np.repeat(np.arange(len(sizes), dtype=np.int64), np.array(sizes, dtype=np.int64))
        keys, n = np.unique(docs * max(1, len(place)) + np.array(terms, dtype=np.int64), return_counts=True)
        return keys // max(1, len(place)), keys % max(1, len(place)), n, np.array(lengths, dtype=np.int64)


def _passes(queries: DataFrame, token: re.Pattern, whole: bool) -> Iterator[Blocks]:
    """Blocks of about ``BLOCK`` queries, ``TOGETHER`` of them at a time."""
    queries = queries.where(F.col("qid").isNotNull())
    n = -(-queries.count() // BLOCK)
    for first in range(0, n, TOGETHER):
        block = F.pmod(F.xxhash64("qid"), F.lit(n)).alias("block")
        rows = queries.select("qid", "query", block).where(F.col("block").between(first, first + TOGETHER - 1)).collect()
        of = [[(r["qid"], r["query"]) for r in rows if r["block"] == k] for k in range(first, min(n, first + TOGETHER))]
        yield Blocks([Block(q, token, whole) for q in of if q], token)


def _statistics(texts: DataFrame, shared) -> tuple[int, float, np.ndarray]:
    """Documents, their mean length, and of each term of the blocks how many hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words, held = 0, 0, np.zeros(len(shared.value.place), dtype=np.int64)
        for part in parts(batches):
            _, terms, _, lengths = shared.value.counted(part.column("text").to_pylist())
            n, words = n + len(lengths), words + int(lengths.sum())
            held += np.bincount(terms, minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[n, words, held[at]])], ["term", "n"])

    rows = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the blocks' terms
    n = rows.get(-2, 0)
    return n, rows.get(-1, 0) / max(1, n), np.array([rows.get(k, 0) for k in range(len(shared.value.place))], dtype=np.float64)


def _first(found: list[np.ndarray], k: int, tie_as_text: bool) -> list[np.ndarray]:
    """(query, document, score, level): the first k of each query."""
    q, d, s, level = found
    order = np.lexsort((d.astype(str) if tie_as_text else d, -level, -s, q))
    q = q[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return [x[order[place < k]] for x in found]


def scored_topk(docs: DataFrame, queries: DataFrame, k: int, weigh: Callable, tie_as_text: bool = False, with_statistics: bool = True, token: re.Pattern = _TOKEN, whole: bool = False) -> DataFrame:
    """docs (doc_id, text, keep) and queries (qid, query) -> qid, doc_id, score, rank: positive scores only, ties by doc_id.

    If docs have a ``level``, ties go by the highest first, then by doc_id. With ``whole`` a query names each of its terms once, and a
    document with one of them scores one more if its text, given in lower case, holds the query as it is.

    Ids are integers; documents and queries without one are left out.

    A score is the sum over shared terms of how often the query names the term
    times weigh(n, df, avgdl)(count, term, length of the document).
    """
    every, context = None, docs.sparkSession.sparkContext
    level = F.coalesce(F.col("level").cast("double"), F.lit(float("-inf"))) if "level" in docs.columns else F.lit(0.0)
    for blocks in _passes(queries, token, whole):
        shared = context.broadcast(blocks)
        weight = weigh(*_statistics(docs, shared)) if with_statistics else weigh(0, 0.0, np.zeros(0))

        def score(batches: Iterator[pa.RecordBatch], shared=shared, weight=weight) -> Iterator[pa.RecordBatch]:
            own = shared.value
            best = [[np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)] for _ in own.blocks]
            for part in parts(batches):
                ids, levels = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), part.column("level").to_numpy(zero_copy_only=False)
                texts = part.column("text").to_pylist()
                docs_of, terms, n, lengths = own.counted(texts)
                weights = weight(n, terms, lengths[docs_of])
                for b, block in enumerate(own.blocks):
                    places, asked, found = own.own[b][terms], block.asked(), [best[b]]
                    step = max(1, CELLS // max(1, len(block.terms), len(block.ids)))
                    for at in range(0, len(ids), step):
                        lo, hi = np.searchsorted(docs_of, [at, at + step])
                        mine = np.flatnonzero(places[lo:hi] >= 0) + lo
                        matrix = np.zeros((min(step, len(ids) - at), len(block.terms)))
                        matrix[docs_of[mine] - at, places[mine]] = weights[mine]
                        scores = np.round(matrix @ asked, 6)
                        if whole:
                            block.add_whole(scores, texts[at : at + step])
                        least = -np.partition(-scores, k - 1, axis=0)[k - 1] if len(scores) > k else np.zeros(scores.shape[1])
                        d, q = np.nonzero((scores > 0) & (scores >= least))
                        found.append([q, ids[at + d], scores[d, q], levels[at + d]])
                    best[b] = _first([np.concatenate(x) for x in zip(*found)], k, tie_as_text)
            for block, (q, d, s, at) in zip(own.blocks, best):
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(d), pa.array(s), pa.array(at)], ["qid", "doc_id", "score", "level"])

        found = docs.where("keep and doc_id is not null").select("doc_id", "text", level.alias("level")).mapInArrow(score, "qid long, doc_id long, score double, level double")
        every = found if every is None else every.unionByName(found)
    if every is None:
        return queries.select(F.col("qid").cast("long"), F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("level"), F.col("doc_id").cast("string") if tie_as_text else F.col("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("level")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, keep: Column | None = None) -> DataFrame:
    """docs (doc_id, text, ...) and queries (qid, query) -> qid, doc_id, score, rank.

    A filter drops documents but not their part in the statistics. Repeated terms
    of a query count repeatedly; only positive scores survive; ties by doc_id.
    """
    marked = docs.select("doc_id", "text", (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("keep"))

    def weigh(n: int, avgdl: float, df: np.ndarray) -> Callable:
        idf, mean = np.log((n - df + 0.5) / (df + 0.5) + 1), max(avgdl, 1e-9)
        return lambda tf, term, dl: idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))

    return scored_topk(marked, queries, k, weigh)


def shared_words(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text) and queries (qid, query) -> qid, doc_id, score, rank: the share of a query's distinct words that a text holds."""
    marked = docs.select("doc_id", "text", F.lit(True).alias("keep"))
    asked = queries.select("qid", F.array_distinct(tokens(F.col("query"))).alias("words")).where(F.size("words") > 0)
    hits = scored_topk(marked, asked.select("qid", F.array_join("words", " ").alias("query")), k, lambda n, avgdl, df: lambda tf, term, dl: np.ones(len(tf)), with_statistics=False)
    return hits.join(asked.select("qid", F.size("words").alias("n")), "qid").select("qid", "doc_id", F.round(F.col("score") / F.col("n"), 6).alias("score"), "rank")


def terms_and_whole(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text, level) and queries (qid, query) -> qid, doc_id, score, rank: distinct shared terms, and one more if the text holds the whole query."""
    marked = docs.select("doc_id", F.lower("text").alias("text"), "level", F.lit(True).alias("keep"))
    return scored_topk(marked, queries.select("qid", F.lower("query").alias("query")), k, lambda n, avgdl, df: lambda tf, term, dl: np.ones(len(tf)), with_statistics=False, token=_TERM, whole=True)


def sparse_topk(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Inner product of term counts; ties by the id as a string."""
    marked = docs.select("doc_id", "text", F.lit(True).alias("keep"))
    return scored_topk(marked, queries, k, lambda n, avgdl, df: lambda tf, term, dl: tf.astype(float), tie_as_text=True, with_statistics=False)


def holders(docs: DataFrame, passages: DataFrame, block_chars: int = 32_000_000) -> DataFrame:
    """docs (doc_id, text) and passages (qid, passage) -> qid, doc_id: documents that hold a passage as it is.

    Passages go out in blocks as one automaton each, with which a text is read once.
    """
    known = passages.where(F.length("passage") > 0).select("qid", "passage")
    n = -(-(known.agg(F.sum(F.length("passage"))).first()[0] or 0) // block_chars)
    found = None
    for block in range(n):
        part = known if n == 1 else known.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == block)
        ids: dict[str, list[int]] = {}
        for r in part.collect():
            ids.setdefault(r["passage"], []).append(r["qid"])
        shared = docs.sparkSession.sparkContext.broadcast(ids)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for passage, qids in shared.value.items():
                automaton.add_word(passage, qids)
            automaton.make_automaton()
            for batch in batches:
                hits = [(q, d) for d, text in zip(batch["doc_id"], batch["text"]) if text for q in {q for _, qids in automaton.iter(text) for q in qids}]
                yield pd.DataFrame(hits, columns=["qid", "doc_id"], dtype="int64")

        each = docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(search, "qid long, doc_id long")
        found = each if found is None else found.unionByName(each)
    return found if found is not None else known.selectExpr("cast(qid as long) qid", "0L doc_id").limit(0)
