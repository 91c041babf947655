"""Exact search of vectors by tiles: some of the vectors against some of the queries, as one matrix product in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors and queries of a tile, and the queries whose products are held at once.
VECTORS, QUERIES, AT_ONCE = 32768, 4096, 64
#: Numbers that the vectors of a tile, and its queries, hold at most: with long vectors they are fewer.
NUMBERS = 1 << 23
#: Rows of a tile of which only the best is looked at first.
FOLD = 32


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of numbers -> rows padded with zeros, their lengths, and which are null or hold a null."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, width = pc.list_flatten(lists), int(sizes.max(initial=0))
    unknown = lists.is_null().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    if flat.null_count:
        unknown[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width), sizes, unknown
    x = np.zeros((len(sizes), width))
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return x, sizes, unknown


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _summed(a: np.ndarray, b: np.ndarray, i: np.ndarray | slice = slice(None), j: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Products of rows i of a and j of b added up from first to last, as functions.vectors.dot does, so that both round alike."""
    s = np.zeros(len(a) if isinstance(i, slice) else len(i))
    for n in range(a.shape[1]):
        s += a[i, n] * b[j, n]
    return s


def candidates(names: pa.ChunkedArray, x: tuple, q: tuple, k: int, by: str):
    """Pairs (row of x, row of q, score, known) of a tile among which each query's first k are, whatever the last bits of its scores.

    The matrix product, right to ``slack``, says which rows can be among the first k once scores are cut to six decimals; those are
    scored again from first to last. Of rows with one and the same score only the first k by name stay.
    """
    (x, x_size, x_unknown), (q, q_size, q_unknown) = x, q
    width = max(x.shape[1], q.shape[1])
    x, q = _widened(x, width), _widened(q, width)
    x_norm, q_norm = np.sqrt(_summed(x, x)), np.sqrt(_summed(q, q))
    if by == "cosine":
        left = np.divide(x, x_norm[:, None], out=np.zeros_like(x), where=x_norm[:, None] != 0)
        right = np.divide(q, q_norm[:, None], out=np.zeros_like(q), where=q_norm[:, None] != 0)
        slack = np.full(len(q), 2e-6)
    else:
        left, right = x, q
        slack = 2e-6 + 4 * (width + 1) * np.finfo(float).eps * np.nan_to_num(x_norm, nan=0.0).max(initial=0.0) * np.nan_to_num(q_norm, nan=0.0)
    even = not x_unknown.any() and not q_unknown.any() and bool((x_size == width).all() and (q_size == width).all())
    place = None
    for at in range(0, len(q), AT_ONCE):
        to = min(at + AT_ONCE, len(q))
        s = left @ right[at:to].T
        np.copyto(s, np.inf, where=np.isnan(s))  # NaN comes first, as the largest number.
        if not even:
            known = ~x_unknown[:, None] & ~q_unknown[at:to] & ((x_size[:, None] == q_size[at:to]) | (by == "cosine") & (x_norm[:, None] * q_norm[at:to] == 0))
            np.copyto(s, -np.inf, where=~known)  # A score that is null comes last.
        fold = len(s) // FOLD
        best = s[: fold * FOLD].reshape(FOLD, fold, to - at).max(axis=0) if fold >= k else s
        if len(best) > k:
            least = np.partition(best, len(best) - k, axis=0)[len(best) - k]
            least = least - np.where(np.isfinite(least), slack[at:to], 0.0)
            i, j = np.nonzero(s >= np.where(np.isnan(least), -np.inf, least))
        else:
            i, j = (m.ravel() for m in np.indices(s.shape))
        sure = np.ones(len(i), bool) if even else known[i, j]
        j = j + at
        score = _summed(x, q, i, j)
        if by == "cosine":
            size = x_norm[i] * q_norm[j]
            score = np.where(size == 0, 0.0, np.divide(score, size, out=np.zeros_like(score), where=size != 0))
        if len(i) > 4 * k * (to - at):
            if place is None:
                texts = names.to_pylist()
                place = np.empty(len(texts), np.int64)
                place[sorted(range(len(texts)), key=lambda n: (texts[n] is not None, texts[n]))] = np.arange(len(texts))
            key = np.where(sure, score, np.nan)
            order = np.lexsort((place[i], key, ~sure, j))
            a, b, u = j[order], key[order], sure[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (u[1:] != u[:-1]) | ((b[1:] != b[:-1]) & ~(np.isnan(b[1:]) & np.isnan(b[:-1])))
            starts = np.flatnonzero(new)
            kept = order[np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) < k]
            i, j, score, sure = i[kept], j[kept], score[kept], sure[kept]
        yield i, j, score, sure


def _parts(rows: DataFrame, column: str, size: int) -> int:
    """Parts of about ``size`` rows and at most about ``NUMBERS`` numbers, by the longest list."""
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size(column))).first()
    return max(1, -(-n // max(1, min(size, NUMBERS // max(1, width or 0)))))


def near_pairs(vectors: DataFrame, queries: DataFrame, k: int, by: str) -> DataFrame:
    """vectors (id, vec) and queries (qid, qvec) -> qid, id, score: each query's first k by score and id, and few others.

    Both sides are dealt by hash into parts of about ``VECTORS`` and ``QUERIES`` rows, fewer if the vectors are long, and each part of
    one meets each of the other, so a task holds one tile however large the tables are.
    """
    parts, blocks = _parts(vectors, "vec", VECTORS), _parts(queries, "qvec", QUERIES)
    part, block = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    left = vectors.select(part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", F.col("id").cast("string").alias("name"), "vec")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), block.alias("block"), "qid", "qvec")
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.schema]}

    def tile(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, qids, found = rows["id"], asked["qid"], []
        if len(ids) and len(qids):
            with np.errstate(all="ignore"):
                for i, j, score, sure in candidates(rows["name"], matrix(rows["vec"]), matrix(asked["qvec"]), k, by):
                    found.append(pa.table({"qid": qids.take(pa.array(j)), "id": ids.take(pa.array(i)), "score": pa.array(score, mask=~sure)}))
        return pa.concat_tables(found) if found else pa.table({"qid": qids.slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64())})

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(tile, f"qid {kinds['qid']}, id {kinds['id']}, score double")
