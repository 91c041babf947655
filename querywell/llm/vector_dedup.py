"""Embedding near-duplicates by an epsilon grid order join.

Cosine >= t means that the normalised vectors lie within eps = sqrt(2 - 2t).
Vectors are rotated onto their leading principal directions (distances only
shrink), put into grid cells of width eps and sorted by label and cell, in the
lexicographic order of the cells. The sorted sequence is cut into intervals of
about ``interval_rows`` vectors. Two intervals are joined only if their first
cells and their bounds on all leading directions allow a distance of eps; within
a pair, both sequences are halved again and again, provably distant halves are
skipped, and small ones are compared exactly in double precision.

Equal vectors are one class with a count. Each joined pair returns numbers of
links and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drawn, durable, min_labels
from .components import connected_components

COSINE, INTERVAL_ROWS, DIRECTIONS, SAMPLE = 0.93, 16_384, 16, 4096
#: Rows that are packed into a run, at most; runs that follow each other share an interval.
RUN_ROWS, LEAF, SLACK = 4096, 256, 1e-6


def principal_directions(classes: DataFrame, directions: int = DIRECTIONS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each number of dimensions an orthonormal basis of the leading directions.

    Fitted on about ``sample`` vectors at most, drawn by hash. The
    basis only decides how much is skipped: any orthonormal one is right.
    """
    rows = drawn(classes, sample, "rep").select("embedding").collect()
    found = {}
    for dim in {len(r["embedding"]) for r in rows}:
        x = _unit(np.array([r["embedding"] for r in rows if len(r["embedding"]) == dim], dtype=np.float64))
        _, basis = np.linalg.eigh(x.T @ x - len(x) * np.outer(x.mean(0), x.mean(0)))
        found[dim] = np.ascontiguousarray(basis[:, ::-1][:, :directions])
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _basis(bases: dict[int, np.ndarray], dim: int, directions: int) -> np.ndarray:
    return bases[dim] if dim in bases else np.eye(dim)[:, :directions]


class _PairJoin:
    """Links between two sequences of unit vectors, or within one."""

    def __init__(self, a, b, weights_a, weights_b, projected_a, projected_b, cosine: float, same: bool):
        self.a, self.b, self.wa, self.wb, self.cosine, self.same = a, b, weights_a, weights_b, cosine, same
        self.bounds = [self._tiles(p) for p in (projected_a, projected_b)]
        self.reach = 2 - 2 * cosine + SLACK
        self.links_a, self.links_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        self.i, self.j = [], []
        self._join(0, len(self.bounds[0][0]), 0, len(self.bounds[1][0]))

    @staticmethod
    def _tiles(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.arange(0, len(p), LEAF)
        return np.minimum.reduceat(p, cuts), np.maximum.reduceat(p, cuts)

    def _join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        (low_a, high_a), (low_b, high_b) = self.bounds
        if self.same and a0 >= b1:
            return
        gap = np.maximum(0, np.maximum(low_b[b0:b1].min(0) - high_a[a0:a1].max(0), low_a[a0:a1].min(0) - high_b[b0:b1].max(0)))
        if (gap * gap).sum() > self.reach:
            return
        if a1 - a0 == 1 and b1 - b0 == 1:
            self._leaf(a0 * LEAF, b0 * LEAF)
            return
        ma, mb = (a0 + a1 + 1) // 2, (b0 + b1 + 1) // 2
        for x in ((a0, ma), (ma, a1)):
            for y in ((b0, mb), (mb, b1)):
                if x[0] < x[1] and y[0] < y[1]:
                    self._join(*x, *y)

    def _leaf(self, i0: int, j0: int) -> None:
        a, b = self.a[i0 : i0 + LEAF], self.b[j0 : j0 + LEAF]
        dots = a @ b.T
        hit = dots >= self.cosine
        for i, j in zip(*np.nonzero(np.abs(dots - self.cosine) < 1e-9)):  # at the threshold: one fixed order of sums
            hit[i, j] = float(np.dot(a[i], b[j])) / float(np.sqrt(np.dot(a[i], a[i]) * np.dot(b[j], b[j]))) >= self.cosine
        diagonal = self.same and i0 == j0
        if diagonal:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.links_a[i0 : i0 + LEAF] += hit @ self.wb[j0 : j0 + LEAF]
        if not diagonal:
            self.links_b[j0 : j0 + LEAF] += self.wa[i0 : i0 + LEAF] @ hit
        labels = min_labels(len(a) + len(b), *(np.nonzero(hit) if diagonal else (np.nonzero(hit)[0], len(a) + np.nonzero(hit)[1])))
        place = np.r_[np.arange(i0, i0 + len(a)), (0 if self.same else len(self.a)) + np.arange(j0, j0 + len(b))]
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        self.i.append(place[moved])
        self.j.append(place[labels[moved]])

    def result(self, ids_a: np.ndarray, ids_b: np.ndarray) -> pd.DataFrame:
        ids, links = (ids_a, self.links_a + self.links_b) if self.same else (np.r_[ids_a, ids_b], np.r_[self.links_a, self.links_b])
        if not self.i:
            return pd.DataFrame({"rep": [], "root": [], "links": []}, dtype="int64")
        labels = min_labels(len(ids), np.concatenate(self.i), np.concatenate(self.j))
        own = np.flatnonzero(links > 0)
        return pd.DataFrame({"rep": ids[own], "root": ids[labels[own]], "links": links[own]})


def _intervals(sorted_rows: DataFrame, bases: dict[int, np.ndarray], directions: int, run_rows: int) -> DataFrame:
    """The sorted sequence, packed: a row for each run of one label, at most run_rows long."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        seq = 0

        def flush():
            run = pd.concat(held, ignore_index=True)
            dim = int(run["dim"].iloc[0])
            x = np.stack(run["embedding"].to_numpy())
            p = _unit(x.astype(np.float64)) @ _basis(bases, dim, directions)
            return pd.DataFrame({"label": [run["label"].iloc[0]], "dim": [dim], "seq": [seq], "n": [len(run)], "low": [p.min(0)], "high": [p.max(0)], "reps": [run["rep"].to_numpy("<i8").tobytes()], "counts": [run["n"].to_numpy("<i8").tobytes()], "vectors": [x.tobytes()]})

        for batch in batches:
            keys = batch["label"].to_numpy() * 1_000_003 + batch["dim"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for start, end in zip(cuts, np.r_[cuts[1:], len(keys)]):
                at = start
                while at < end:
                    have = sum(map(len, held))
                    if held and (have == run_rows or (held[0]["label"].iloc[0], held[0]["dim"].iloc[0]) != (batch["label"].iloc[at], batch["dim"].iloc[at])):
                        yield flush()
                        held, have, seq = [], 0, seq + 1
                    upto = min(end, at + run_rows - have)
                    held.append(batch.iloc[at:upto])
                    at = upto
        if held:
            yield flush()

    packed = sorted_rows.mapInPandas(pack, "label long, dim int, seq long, n long, low array<double>, high array<double>, reps binary, counts binary, vectors binary")
    return packed.select(F.spark_partition_id().alias("part"), "*")


def linked_classes(classes: DataFrame, cosine: float = COSINE, interval_rows: int = INTERVAL_ROWS, directions: int = DIRECTIONS) -> DataFrame:
    """Distinct vectors (label, rep, n, embedding) -> rep, root, links for those with links; several rows of a rep add up.

    No column may hold null, vectors must be finite and not zero (see
    ``vector_groups``); vectors of different length are not compared; no rows
    give no rows. Other columns are ignored.
    """
    bases, eps = principal_directions(classes, directions), float(np.sqrt(2 - 2 * cosine))
    shared = classes.sparkSession.sparkContext.broadcast(bases)

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        out = [None] * len(vectors)
        for dim, at in vectors.groupby(vectors.map(len)).groups.items():
            rows = vectors.index.get_indexer(at)
            p = _unit(np.stack(vectors.iloc[rows].to_numpy()).astype(np.float64)) @ _basis(shared.value, dim, directions)
            for k, c in zip(rows, np.floor(p / eps).astype(np.int32)):
                out[k] = c
        return pd.Series(out)

    placed = classes.select(F.col("label").cast("long").alias("label"), F.size("embedding").alias("dim"), "rep", "n", "embedding").withColumn("cell", cells("embedding"))
    order = ["label", "dim", "cell", "rep"]
    run_rows = min(RUN_ROWS, interval_rows)
    partitions = max(1, ceil(classes.count() / run_rows))
    sequence = placed.repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop("cell")
    packed = durable(_intervals(sequence, bases, directions, run_rows))

    # Runs that follow each other share an interval: a vector is sent once for each interval near its own, not for each run.
    before = Window.partitionBy("label", "dim").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    runs = packed.select("label", "dim", "part", "seq", "low", "high", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / interval_rows).alias("interval"))
    runs = durable(runs)
    ends = [F.min(F.get("low", F.lit(k))) for k in range(directions)], [F.max(F.get("high", F.lit(k))) for k in range(directions)]
    bounds = durable(runs.groupBy("label", "dim", "interval").agg(F.array(*ends[0]).alias("low"), F.array(*ends[1]).alias("high")))
    first, last = (F.floor(F.col(c)[0] / eps) for c in ("low", "high"))
    left = bounds.select("label", "dim", F.col("interval").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(first - 1, last + 1)).alias("cell"))
    right = bounds.select("label", "dim", F.col("interval").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(first, last)).alias("cell"))
    gap = F.zip_with(F.zip_with("low_b", "high_a", lambda x, y: x - y), F.zip_with("low_a", "high_b", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + F.coalesce(g * g, F.lit(0.0))) <= 2 - 2 * cosine + SLACK
    pairs = left.join(right, ["label", "dim", "cell"]).where(F.col("a") <= F.col("b")).where(near).select("label", "dim", "a", "b").distinct()

    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("interval")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("interval")), F.struct(F.lit(1).alias("side"), F.col("b").alias("interval")))
    )
    needed = pairs.select("label", "dim", "a", "b", F.inline(sides))
    members = needed.join(runs.select("label", "dim", "interval", "part", "seq"), ["label", "dim", "interval"])
    loads = members.join(packed.select("part", "seq", "reps", "counts", "vectors"), ["part", "seq"])

    kind = np.dtype(np.float32 if classes.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64)

    def join(pair: pd.DataFrame) -> pd.DataFrame:
        dim = int(pair["dim"].iloc[0])
        sides = []
        for _, rows in pair.sort_values(["part", "seq"]).groupby("side"):
            x = _unit(np.frombuffer(b"".join(rows["vectors"]), dtype=kind).reshape(-1, dim).astype(np.float64))
            sides.append((x, np.frombuffer(b"".join(rows["counts"]), dtype="<i8"), x @ _basis(shared.value, dim, directions), np.frombuffer(b"".join(rows["reps"]), dtype="<i8")))
        a, b = sides[0], sides[-1]
        return _PairJoin(a[0], b[0], a[1], b[1], a[2], b[2], cosine, len(sides) == 1).result(a[3], b[3])

    return loads.groupBy("label", "dim", "a", "b").applyInPandas(join, "rep long, root long, links long")


def vector_groups(embeddings: DataFrame, cosine: float = COSINE, interval_rows: int = INTERVAL_ROWS, directions: int = DIRECTIONS) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept; one row per row.

    Vectors are compared if their labels are equal and known. A vector that is
    null, empty, zero or holds a null or non-finite component, or whose label or
    id is null, has no links and is its own component; so are vectors of
    different length to each other. Rows that repeat a vector link with each
    other. Other columns are ignored; an empty table gives no rows.
    """
    exact = embeddings.schema["embedding"].dataType.elementType.typeName() == "float"
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<float>" if exact else "array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good, bad = rows.where(valid), rows.where(~valid)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # An id may repeat on different vectors, so a class gets a number of its own; the checkpoint fixes it.
    classes = durable(classes.withColumn("rep", F.monotonically_increasing_id()))
    found = durable(linked_classes(classes, cosine, interval_rows, directions))
    joined = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    rooted = classes.join(links, "rep", "left").join(joined, classes["rep"] == joined["node"], "left")
    rooted = rooted.select("label", "embedding", "n", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("label", "embedding", (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    out = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
