"""SimHash near-duplicates, found by covering locality-sensitive hashing.

For radius r, each of the 64 bit positions gets a non-zero vector of r+1 bits;
each of the 2^(r+1)-1 non-zero vectors v gives a mask with the positions whose
vector has an odd product with v. At most r positions differ in a linked pair,
their vectors span at most r dimensions, so some v is orthogonal to all of them:
under that mask both fingerprints are equal. Every pair within the radius thus
collides in some table: no link is lost to chance.

Only distinct fingerprints take part. A bucket of more than ``bucket_rows``
fingerprints is covered again with further masks (each level leaves about
7/15 of the free bits), which is exact for the same reason and leaves at most a
few free bits, that is a bounded bucket, after four levels. Each bucket yields a
spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, is_empty, whole_groups
from .components import connected_components

RADIUS, SHINGLE, SEED, BUCKET_ROWS, LEVELS = 3, 3, 42, 4096, 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)))]
    ones = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype="<u8").view(np.uint8)
    for at in range(0, len(values), 1 << 19):
        ones += np.unpackbits(values[at : at + (1 << 19)], bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def masks(level: int, radius: int = RADIUS) -> list[int]:
    """The covering masks of a level as signed longs; each level deals the vectors out anew."""
    kinds = 2 ** (radius + 1) - 1
    vectors = np.random.default_rng(1000 + level).permutation([1 + k % kinds for k in range(64)])
    found = [sum(1 << k for k in range(64) if (int(vectors[k]) & v).bit_count() % 2) for v in range(1, kinds + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _forest(bucket: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of one bucket, breadth first."""
    left = bucket
    while len(left) > 1:
        root, left, wave = int(left[0]), left[1:], [left[0]]
        while wave and len(left):
            near = np.bitwise_count(left ^ wave.pop()) <= radius
            if near.any():
                for x in left[near]:
                    yield int(x), root
                wave.extend(left[near])
                left = left[~near]


def _links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    for batch in whole_groups(batches, "bucket"):
        keys, prints = batch["bucket"].to_numpy(), batch["fp"].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        src, dst = [], []
        small = np.repeat(np.where((sizes > 1) & (sizes < 8), sizes, 0), sizes)
        for step in range(1, 8):
            at = np.flatnonzero((small[:-step] > step) & (keys[step:] == keys[:-step])) if len(keys) > step else np.empty(0, int)
            near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= radius]
            src.append(prints[near])
            dst.append(prints[near + step])
        more = [x for s, n in zip(starts, sizes) if n >= 8 for x in _forest(prints[s : s + n], radius)]
        if more:
            a, b = np.array(more, dtype=np.int64).T
            src.append(a)
            dst.append(b)
        src, dst = np.concatenate(src), np.concatenate(dst)
        if len(src):
            yield pd.DataFrame({"src": src, "dst": dst}).drop_duplicates()


def covering_links(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct (fp) -> (src, dst): links that join all fingerprints within the radius."""
    parts, rows = [], prints.select("fp", F.lit(0).cast("long").alias("bucket"))
    for level in range(LEVELS):
        tables = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate(masks(level, radius))))
        rows = rows.select("fp", "bucket", F.explode(tables).alias("t"))
        rows = rows.select("fp", F.xxhash64("bucket", "t.k", F.col("fp").bitwiseAND(F.col("t.m"))).alias("bucket"))
        if level == LEVELS - 1:
            break
        hot = durable(rows.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket"))
        if is_empty(hot):
            break
        parts.append(rows.join(hot, "bucket", "left_anti"))
        rows = rows.join(hot, "bucket", "left_semi")
    for part in parts:
        rows = rows.unionByName(part)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInPandas(lambda b: _links(b, radius), "src long, dst long")


def _print_of(shingle: int):
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return fp


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp)."""
    return docs.select("doc_id", _print_of(shingle)("text").alias("fp"))


def _rows(docs: DataFrame, radius: int, shingle: int, bucket_rows: int) -> DataFrame:
    """(doc_id, text) -> doc_id, fp, component_id, kept_fp; one row per row.

    A component keeps its row of (component_id, kept_fp): of the smallest id, nulls
    last, and of that id's smallest fingerprint.
    """
    base = durable(fingerprints(docs, shingle))
    distinct = durable(base.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = connected_components(covering_links(distinct, radius, bucket_rows))
    rooted = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.min(F.struct(F.col("first").isNull(), "first", "fp"))["fp"].alias("kept_fp"))
    named = rooted.join(least, "root").select("fp", "component_id", "kept_fp")
    return base.join(named, "fp").select("doc_id", "fp", "component_id", "kept_fp")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint, component_id; one row per row.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other. Exact copies share a fingerprint and so a component. Repeated rows
    each keep a row; null ids are never a component's id unless it has no other.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = _rows(docs, radius, shingle, bucket_rows)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents without all but one row of each SimHash group, that of the smallest doc_id.

    All columns stay as they are. Of a group without ids one row stays. An id
    that stands on texts of different groups is judged in each group by itself;
    of rows with the same id and fingerprint one stays.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("kept_fp"))
    groups = durable(_rows(docs, radius, shingle, bucket_rows).select("doc_id", "fp", kept.alias("kept")))
    gone = groups.where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone_id"))
    repeated = durable(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("repeated_id")))
    # An id of one row says which row it is; rows of null and repeated ids are told apart by their fingerprint as well.
    no_repeats, no_nulls = is_empty(repeated), is_empty(groups.where("doc_id is null"))
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # the columns by place, so that no name of theirs can clash
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in own.items()))
    back = [F.col(k).alias(c) for c, k in own.items()]
    doc_id, text = own["doc_id"], own["text"]
    if no_repeats and no_nulls:
        return rows.join(gone, rows[doc_id] == gone["gone_id"], "left_anti").select(*back)
    known = rows.where(F.col(doc_id).isNotNull())
    single, several = known.join(gone, known[doc_id] == gone["gone_id"], "left_anti"), rows.where(F.col(doc_id).isNull())
    if not no_repeats:
        single = single.join(repeated, single[doc_id] == repeated["repeated_id"], "left_anti")
        several = several.unionByName(known.join(repeated, known[doc_id] == repeated["repeated_id"], "left_semi"))
    first = groups.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("fp").alias("kept_fp")).distinct()
    several = several.withColumn("own_fp", _print_of(shingle)(text))
    several = several.join(first, several[doc_id].eqNullSafe(first["kept_id"]) & (several["own_fp"] == first["kept_fp"]), "left_semi")
    return single.unionByName(several.dropDuplicates([doc_id, "own_fp"]).drop("own_fp")).select(*back)
