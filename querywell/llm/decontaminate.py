"""Benchmark decontamination by CGK embeddings, bit sampling and exact edit distance.

An item matches a document if some window of the document with as many words as
the item lies within a word edit distance of ``(1 - similarity) * words``. Words
are lower-case runs between white space and punctuation (ASCII, CJK and full-width);
in scripts without spaces each character is a word. Items of fewer than
``min_words`` words match as exact word sequences only. Before a text's begin and
behind its end stand places that equal no word, so a text may be shorter than an
item that it matches.

All steps are in the task that holds the document, without a shuffle:

1. Windows that can match at all (loses nothing): one within distance d of an item
   holds all but d of any words chosen from it. Chosen are its words that few
   items hold, and more than d in any case; places of these words, sorted by item,
   tell which windows hold enough of them. Then all but d words must be the item's.
2. CGK: a random walk copies a window's word and moves on by a bit drawn from
   (walk, step, word), so that few edits change few places of the copy. A band is
   some sampled places of a walk's copy; window and item become candidates if they
   are equal in any band of any walk. How many places a band has is set for each
   length by simulating edits at the limit, so that the recall is ``RECALL`` there
   even for the worst pair, and higher below; a length at which even one place does not reach it has every
   window of step 1 verified.
3. The exact edit distance of the candidates, and where one matches of the item's
   other windows in that text, many at a time. Window and
   item are equally long, so only cells within d / 2 of the diagonal count.

The items are the stated query set: they go to the tasks in blocks of at most
``block_chars`` characters, one pass over the documents for each block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILARITY, MIN_WORDS = 0.8, 5
#: CGK walks, bands of each, the most places of a band, and the recall at the allowed distance, of the worst simulated pair.
WALKS, BANDS, SAMPLES, RECALL = 4, 16, 4, 0.99
BLOCK_CHARS, PIECE_WORDS, RARE = 32_000_000, 1 << 20, 8
#: Cells of a window block that is held at a time, and windows whose band keys are.
CELLS, KEYED = 1 << 22, 1 << 14
_PLAIN = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
#: Punctuation of East Asian texts, and characters of scripts that set no spaces: Thai to Khmer, Tai, kana, Han.
_WIDE = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u303d-\u303f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_UNSPACED = re.compile("([\u0e00-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3005-\u3007\u3021-\u302f\u3031-\u303c\u3040-\u30fa\u30fc-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9df\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")


def words_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", _WIDE.sub(" ", text))
    return text.lower().encode().translate(_PLAIN).split()


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance of two sequences, or most + 1 if it is larger."""
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (b != x), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return most + 1
    return min(int(row[-1]), most + 1)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word edit distances of the columns of a and b, all of one length; more than most where they are larger."""
    n, half = len(a), most // 2
    steps = np.arange(2 * half + 1, dtype=np.int32)[:, None]
    b = np.pad(b, ((half, half), (0, 0)), constant_values=-2)
    out, left = np.full(a.shape[1], most + 1, dtype=np.int32), np.arange(a.shape[1])
    # Row o of the band is the cell half - o beside the diagonal.
    row = np.repeat(np.where(steps < half, most + 1, steps - half).astype(np.int32), a.shape[1], axis=1)
    for i in range(n):
        new = row + (b[i : i + 2 * half + 1] != a[i])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - steps, axis=0) + steps if half else new
        if i % 8 == 7:
            near = row.min(axis=0) <= most
            if 2 * near.sum() < len(near):
                a, b, row, left = a[:, near], b[:, near], row[:, near], left[near]
                if not len(left):
                    return out
    out[left] = np.minimum(row[half], most + 1)
    return out


def places_of(n: int) -> int:
    """How many steps a walk over n words takes: it moves at every second one, and most walks are not at the end yet."""
    return max(n, int(1.8 * n))


def embedded(rows: np.ndarray, walks: int) -> Iterator[np.ndarray]:
    """Of each step, what the walks copy of the columns of rows (words x windows): walks x windows."""
    n, width = rows.shape
    at, columns = np.zeros((walks, width), dtype=np.int64), np.arange(width)
    rows = np.concatenate([rows, np.zeros((1, width), dtype=rows.dtype)])
    salt = (np.arange(walks, dtype=np.uint32) * np.uint32(0x9E3779B1))[:, None]
    for step in range(places_of(n)):
        copied = rows[at, columns]
        yield copied
        mixed = copied.astype(np.uint32) * np.uint32(0x85EBCA77) + salt + np.uint32(step * 0xC2B2AE3D & 0xFFFFFFFF)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        mixed ^= mixed >> np.uint32(13)
        at = np.minimum(at + ((mixed >> np.uint32(9)) & np.uint32(1)), n)


@cache
def band_shape(n: int, most: int, walks: int, bands: int, samples: int, recall: float) -> tuple[int, int]:
    """(places of a band, bands): the most places, up to ``samples``, that keep the recall for n words and ``most`` edits.

    If one place does not, up to 8 times the bands are tried; (0, 0) if these do not either.

    Simulated on distinct words, once with substitutions and once with deletions
    and insertions; words that repeat only make more places equal.
    """
    if not most:
        return samples, bands
    rng, tries = np.random.default_rng(n), 48
    pairs = np.empty((2, n, 2 * tries), dtype=np.int32)
    for t in range(2 * tries):
        words = list(range(1, n + 1))
        if t < tries:
            for at in rng.permutation(n)[:most]:
                words[at] = n + 1 + int(at)
        else:
            for _ in range(most // 2):
                del words[int(rng.integers(len(words)))]
                words.insert(int(rng.integers(len(words) + 1)), 2 * n + 1 + int(rng.integers(n)))
        pairs[0, :, t], pairs[1, :, t] = np.arange(1, n + 1), words
    same = sum(((a == b) & (a != 0)).astype(float) for a, b in zip(embedded(pairs[0], walks), embedded(pairs[1], walks)))
    share = same / places_of(n)  # of each walk and try
    for m, b in [*((m, bands) for m in range(samples, 0, -1)), (1, 2 * bands), (1, 4 * bands), (1, 8 * bands)]:
        missed = np.prod((1 - share**m) ** b, axis=0)
        if 1 - missed.max() >= recall:
            return m, b
    return 0, 0


def band_keys(rows: np.ndarray, m: int, bands: int, walks: int) -> np.ndarray:
    """(walks * bands) x windows: what each band of m sampled places holds."""
    n, width = rows.shape
    chosen = np.random.default_rng(7 * n + m).integers(0, places_of(n), (walks, bands, m))
    keys = np.zeros((walks, bands, width), dtype=np.uint64)
    # Sampled places by step: which walk and band they belong to, and as which of its places.
    walk, band, part = np.unravel_index(np.argsort(chosen, axis=None, kind="stable"), chosen.shape)
    steps = chosen[walk, band, part]
    begin = np.searchsorted(steps, np.arange(places_of(n) + 1))
    for step, copied in enumerate(embedded(rows, walks)):
        for k in range(begin[step], begin[step + 1]):
            keys[walk[k], band[k]] += (copied[walk[k]].astype(np.uint64) + np.uint64(1)) * np.uint64((0x9E3779B97F4A7C15 * (2 * int(part[k]) + 1)) & 0xFFFFFFFFFFFFFFFF)
    return keys.reshape(walks * bands, width)


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, min_words: int, walks: int, bands: int, samples: int, recall: float = RECALL):
        self.walks = walks
        split = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.ids = [i for i, _ in split]
        seen = Counter(w for _, words in split for w in set(words))
        self.vocabulary = {w: k for k, w in enumerate(sorted(seen), 1)}
        self.words = [np.array([self.vocabulary[w] for w in words], dtype=np.int32) for _, words in split]
        self.most = np.array([int((1 - similarity) * len(w) + 1e-9) if len(w) >= min_words else 0 for w in self.words], dtype=np.int64)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        held = np.array([0, *(seen[w] for w in self.vocabulary)])
        self.edge = len(held)  # the number in place of a word beyond a text's ends; as many on each side as an item allows edits
        self.pad = np.full(int(self.most.max(initial=0)), self.edge, dtype=np.int32)
        holders: list[list[int]] = [[] for _ in range(self.edge + 1)]  # of each word: the items that chose it
        need = []
        for k, w in enumerate(self.words):
            times = Counter(w.tolist())
            total = 0
            for word in sorted(times, key=lambda x: (held[x], x)):
                if held[word] > RARE and total > self.most[k]:
                    break
                holders[word].append(k)
                total += times[word]
            need.append(total - self.most[k])
        self.need = np.array(need, dtype=np.int64)
        self.first = np.cumsum([0, *map(len, holders)])
        self.holders = np.array([k for group in holders for k in group], dtype=np.int64)
        self.band = [band_shape(int(n), int(d), walks, bands, samples, recall) for n, d in zip(self.size, self.most)]
        self.keys: list[np.ndarray | None] = [None] * len(self.words)
        of_size: dict[int, list[int]] = {}
        for k, n in enumerate(self.size):
            of_size.setdefault(int(n), []).append(k)
        for group in of_size.values():
            if self.band[group[0]][0]:
                keys = band_keys(np.stack([self.words[k] for k in group], axis=1), *self.band[group[0]], walks)
                for k, own in zip(group, keys.T):
                    self.keys[k] = own

    def windows(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each item, ranges low to high of where windows start that can match; begin and end: of the text around each word."""
        first, n = self.first[ids], self.first[ids + 1] - self.first[ids]
        place = np.repeat(np.arange(len(ids)), n)
        item = self.holders[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
        order = np.argsort(item, kind="stable")
        place, item = place[order], item[order]
        last = np.arange(len(item)) + self.need[item] - 1
        at = np.flatnonzero(last < len(item))
        last = last[at]
        at, last = (x[(item[at] == item[last]) & (place[last] - place[at] < self.size[item[at]]) & (begin[place[at]] == begin[place[last]])] for x in (at, last))
        item, size = item[at], self.size[item[at]]
        low, high = np.maximum(place[last] - size + 1, begin[place[at]]), np.minimum(place[at], end[place[at]] - size)
        item, low, high = (x[high >= low] for x in (item, low, high))
        # Both bounds rise within an item, so a range begins after the one before it.
        low[1:] = np.where(item[1:] == item[:-1], np.maximum(low[1:], high[:-1] + 1), low[1:])
        item, low, high = (x[high >= low] for x in (item, low, high))
        edges = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True]) if len(item) else []
        for a, b in zip(edges, edges[1:]):
            yield int(item[a]), low[a:b], high[a:b]

    def near(self, k: int, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
        """Starts in the ranges whose window has all but d words from the item's."""
        n, sums = len(self.words[k]), None
        member = np.zeros(self.edge + 1, dtype=bool)
        member[self.words[k]] = True
        if (high - low + 1).sum() * n > len(ids):
            sums = np.r_[0, np.cumsum(member[ids], dtype=np.int32)]
        ends = np.cumsum(high - low + 1)
        width = max(1, CELLS // n)
        for at in range(0, int(ends[-1]), width):
            numbers = np.arange(at, min(at + width, int(ends[-1])))
            own = np.searchsorted(ends, numbers, side="right")
            starts = high[own] - (ends[own] - 1 - numbers)
            held = sums[starts + n] - sums[starts] if sums is not None else member[ids[starts + np.arange(n)[:, None]]].sum(axis=0)
            if len(found := starts[held >= n - self.most[k]]):
                yield found

    def search(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(text's begin, item) -> (distance, start) of the best window, the first among equals."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}  # by size: windows of several items are measured at once

        def measure(n: int) -> None:
            group = waiting.pop(n)
            owner = np.repeat([k for k, _ in group], [len(s) for _, s in group])
            starts, most = np.concatenate([s for _, s in group]), int(self.most[group[0][0]])
            words = np.stack([self.words[k] for k, _ in group], axis=1)
            which = np.repeat(np.arange(len(group)), [len(s) for _, s in group])
            rows = ids[starts + np.arange(n)[:, None]]

            def measured(at: np.ndarray) -> None:
                distances = edit_distances(words[:, which[at]], rows[:, at], most)
                for w, distance in zip(at[distances <= most], distances[distances <= most]):
                    key, value = (int(begin[starts[w]]), int(owner[w])), (int(distance), int(starts[w]))
                    best[key] = min(value, best.get(key, value))

            met = np.ones(len(starts), dtype=bool)
            if self.band[group[0][0]][0]:
                own = np.stack([self.keys[k] for k, _ in group], axis=1)
                for at in range(0, len(starts), KEYED):
                    part = slice(at, at + KEYED)
                    met[part] = (band_keys(rows[:, part], *self.band[group[0][0]], self.walks) == own[:, which[part]]).any(axis=0)
            measured(np.flatnonzero(met))
            if not met.all() and best:  # where an item was found, its other windows may be nearer
                measured(np.flatnonzero(~met & np.array([(b, o) in best for b, o in zip(begin[starts].tolist(), owner.tolist())])))

        for k, low, high in self.windows(ids, begin, end):
            n = len(self.words[k])
            for starts in self.near(k, ids, low, high):
                waiting.setdefault(n, []).append((k, starts))
                if n * sum(len(s) for _, s in waiting[n]) >= CELLS:
                    measure(n)
        for n in list(waiting):
            measure(n)
        return best

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(place of the text, item_id, first word, words, distance), from several texts at a time."""
        get, held, sizes, first, total = self.vocabulary.get, [], [], 0, 0
        for k, text in enumerate(texts):
            words = words_of(text)
            held += [self.pad, np.fromiter(map(get, words, repeat(0)), dtype=np.int32, count=len(words)), self.pad]
            sizes.append(len(words) + 2 * len(self.pad))
            total += sizes[-1]
            if total >= PIECE_WORDS or k + 1 == len(texts):
                begins = np.cumsum(sizes) - sizes
                begin = np.repeat(begins, sizes)
                found = self.search(np.concatenate(held), begin, begin + np.repeat(sizes, sizes))
                owner = {int(b): first + j for j, b in enumerate(begins) if sizes[j]}
                yield from sorted((owner[b], self.ids[item], start - b - len(self.pad), int(self.size[item]), distance) for (b, item), (distance, start) in found.items())
                held, sizes, first, total = [], [], k + 1, 0


def blocks_of(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters, whatever the table's size."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield sorted((r["item_id"], r["text"]) for r in part.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, walks: int = WALKS, bands: int = BANDS, samples: int = SAMPLES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Matches of benchmark (item_id, text) in docs (doc_id, text).

    Returns doc_id, item_id, start (word; below 0 if the window begins before the
    text), n_words, distance: one row per row of docs and matching item, with its
    best window. Null or empty texts match
    nothing; items of fewer than ``min_words`` words match exactly only; repeated
    items count once, repeated documents each. Other columns are ignored; an
    empty table on either side gives no rows.
    """
    texts, parts = docs.select("doc_id", "text").where(F.col("text").isNotNull()), []
    for block in blocks_of(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block, similarity, min_words, walks, bands, samples))

        def match(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                frame = pd.DataFrame(shared.value.matches(batch["text"].tolist()), columns=["at", "item_id", "start", "n_words", "distance"])
                yield frame.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy()[frame.pop("at").to_numpy(dtype=np.int64)])[["doc_id", *frame.columns]]

        parts.append(texts.mapInPandas(match, "doc_id long, item_id long, start long, n_words long, distance long"))
    if not parts:
        return texts.limit(0).selectExpr("doc_id", "0L item_id", "0L start", "0L n_words", "0L distance")
    return reduce(DataFrame.unionByName, parts)


def _leaks(shared):
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        found = np.zeros(len(texts), dtype=bool)
        found[[m[0] for m in shared.value.matches(texts.tolist())]] = True
        return pd.Series(found)

    return leaks


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that match no benchmark item; columns as they are, repeated rows and null ids as well."""
    kept = docs
    options = {"similarity": SIMILARITY, "min_words": MIN_WORDS, "walks": WALKS, "bands": BANDS, "samples": SAMPLES, "block_chars": BLOCK_CHARS} | settings
    for block in blocks_of(benchmark, options.pop("block_chars")):
        leaks = _leaks(docs.sparkSession.sparkContext.broadcast(Items(block, *options.values())))
        kept = kept.where(~leaks("text"))
    return kept
