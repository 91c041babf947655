"""Mixing sources to target weights, in DataFrame functions.

Each row gets a hash-random key. A source's rows are sorted by it over equal
ranges of the key, so that a source of any size is spread over many tasks; each
range sums its sizes, the few sums give each range its offset, and a running sum
within the range completes a distributed prefix sum. A source is taken whole as
often as its budget allows; the rest is cut off at the exact word.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, running

WEIGHTS, MOST_REPEATS, RANGE_ROWS = (1, 2, 3), 3, 2048


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"{WORD}++")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, size) -> source, n, source_size, target; one row per source.

    Shares of the total by weight; what a source cannot use (over ``most`` times
    its size) goes to the others by weight until none is above. That ends when
    target = min(most * size, level * weight) for one level, found from the
    sources in order of most * size / weight: the first whose own level leaves it
    below its ceiling has it, and later ones only give lower levels.

    Null is a source of its own, the last; null sizes count 0; repeated rows count
    each; an empty table gives no rows. Sources may be as many as rows: their
    places and sums are taken over ranges.
    """
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    placed = running(sources, [F.asc_nulls_last("source")], place=F.lit(1).cast("long"))
    placed = placed.withColumn("weight", F.array(*map(F.lit, weights))[(F.col("place") % len(weights)).cast("int")]).withColumn("ceiling", F.col("source_size") * most)
    whole = placed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    if whole["weights"] is None:
        return sources.select("source", "n", "source_size", F.lit(0.0).alias("target"))
    stepped = durable(running(placed, [(F.col("ceiling") / F.col("weight")).asc(), F.asc_nulls_last("source")], capped=F.col("ceiling"), used=F.col("weight").cast("long")))
    own = (F.lit(whole["words"]) - F.col("capped")).cast("double") / (F.lit(whole["weights"]) - F.col("used"))
    level = stepped.agg(F.max(F.when(own * F.col("weight") <= F.col("ceiling"), own)).alias("level")).first()["level"]
    ceiling = F.col("ceiling").cast("double")
    target = ceiling if level is None else F.least(ceiling, F.lit(level) * F.col("weight"))
    return stepped.select("source", "n", "source_size", target.alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, size, source_size, target, taken; one row per row.

    size counts the words of the whole text (0 if null). Keys are md5 of doc_id
    and text, so rows without or with the same id are spread as well; ties go by
    doc_id and size, so reruns agree; rows equal in both share their place in any
    order. A null source is a source of its own, the last. A source without words
    takes none. Other columns are ignored; an empty table gives no rows.
    """
    key = F.md5(F.concat_ws("\n", F.col("doc_id").cast("string"), "text"))
    rows = durable(docs.select("doc_id", "source", words().alias("size"), key.alias("key")))
    targets = durable(source_targets(rows.select("source", "size"), weights, most))
    largest = targets.agg(F.max("n")).first()[0] or 0
    bits = min(28, max(0, ceil(log2(max(1, largest / range_rows)))))
    part = F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") / (1 << (28 - bits))).cast("int")
    ranged = rows.withColumn("part", part)
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"))
    # A running sum over all ranges of all sources, less what stands before the source.
    upto = durable(running(sums, [F.asc_nulls_last("source"), F.col("part").asc()], before=F.col("words")))
    begins = upto.groupBy(F.col("source").alias("b")).agg(F.min("before").alias("begin"))
    offsets = upto.join(begins, F.col("source").eqNullSafe(F.col("b"))).select(F.col("source").alias("s"), F.col("part").alias("p"), (F.col("before") - F.col("begin")).alias("offset"))
    offsets = offsets.join(targets.select(F.col("source").alias("t"), "source_size", "target"), F.col("s").eqNullSafe(F.col("t")))
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("upto", F.sum("size").over(within))
    placed = summed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    partly = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("offset") + F.col("upto") - F.col("size"))))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + partly).cast("long").alias("taken"))


#: The same mix for DuckDB over a table {docs} of doc_id, text, source.
MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(concat_ws(chr(10), doc_id::varchar, text)) as key
  from {docs}
), sources as (
  select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight
  from sized group by source
), stepped as (
  select *, 3 * source_size as ceiling,
    sum(source_size) over () - coalesce(sum(3 * source_size) over w, 0) as rest,
    sum(weight) over () - coalesce(sum(weight) over w, 0) as weights
  from sources
  window w as (order by (3 * source_size) / weight::double, source nulls last rows between unbounded preceding and 1 preceding)
), levels as (
  select *, max(case when (rest::double / weights::double) * weight <= ceiling then rest::double / weights::double end) over () as level
  from stepped
), targets as (
  select source, source_size, least(ceiling::double, coalesce(level * weight, ceiling::double)) as target from levels
), placed as (
  select doc_id, sized.source, size, source_size, target, floor(target + 0.5)::bigint as budget,
    (sum(size) over (partition by sized.source order by key, doc_id nulls first, size rows between unbounded preceding and current row) - size)::bigint as begins
  from sized join targets on sized.source is not distinct from targets.source
)
select doc_id, source, size, source_size, target,
  (case when source_size > 0 then (budget // source_size) * size
    + greatest(0, least(size, budget - (budget // source_size) * source_size - begins)) else 0 end)::bigint as taken
from placed
"""
