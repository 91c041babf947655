"""Line dedup: lines that at least three documents hold stay in the last of them only, as bitmaps of kept lines.

The lines' keys are hashed to 128 bits and dealt over ranges of the hash, within a
range sorted by hash, then document, last first, then position. A window streams
over that order: the first document of a hash keeps its lines, the third and later
ones lose theirs, the second does if there is a third. Texts are not shuffled for
this; what comes back is, for each document, the 64-line words of its bitmap in
which some line is lost.

A hash may hold a large share of all lines. Counts by hash prefix, summed in each task
first, tell which prefixes do; their lines are split into parts by document, and each
part streams by itself. All but the two last documents of a part are decided
there; those two meet those of the other parts in a second window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, once

#: White space of the key rule.
BLANKS = "".join(map(chr, (32, 9, 10, 11, 12, 13)))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 20, 3
#: Prefixes of the hash that are counted, and the rows of one part: so many times the mean of a prefix, so many at least.
PREFIXES, PART_MEANS, PART_ROWS = 1 << 16, 4, 256


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell rows apart by id and text; rows alike in both lose the same lines."""
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))))


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text) -> doc_id, row_key, position, h1, h2; one row per line whose key has ``min_chars`` code points."""
    keyed = once(docs, ["doc_id"], row_key=_row_key(F.col("doc_id"), F.col("text")), lines=_lines_of(F.col("text")))
    rows = keyed.select("doc_id", "row_key", F.posexplode("lines").alias("position", "line"))
    keyed = rows.where(F.char_length(F.trim("line", F.lit(BLANKS))) >= min_chars).withColumn("line", line_key(F.col("line")))
    return keyed.select("doc_id", "row_key", "position", F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"))


def lost_lines(lines: DataFrame, min_docs: int = MIN_DOCS, prefixes: int = PREFIXES, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, row_key, position, h1, h2) -> row_key, position of the lines that go.

    ``min_docs`` is 2 or more. Documents are told apart by doc_id; null is an id, the smallest.
    The lines are written once, so that counting, sampling the ranges and dealing out do not split the texts again.
    """
    lines = durable(lines)
    prefix = F.pmod("h1", F.lit(prefixes)).cast("int")
    counts = durable(lines.groupBy(prefix.alias("hot_prefix")).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    most = max(part_rows, PART_MEANS * total // prefixes)
    # At most prefixes / PART_MEANS prefixes hold more than PART_MEANS times the mean.
    hot = counts.where(F.col("count") > most).select("hot_prefix", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    placed = lines.join(F.broadcast(hot), prefix == F.col("hot_prefix"), "left").drop("hot_prefix")
    split = F.col("parts").isNotNull()
    placed = placed.withColumn("part", F.when(split, F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(F.lit(0)).cast("int")).withColumn("split", split).drop("parts")

    last_first = F.col("doc_id").desc_nulls_last()
    ranged = placed.repartitionByRange("h1", "h2", "part")
    by_part = Window.partitionBy("h1", "h2", "part")
    ranked = ranged.withColumn("place", F.dense_rank().over(by_part.orderBy(last_first))).withColumn("docs", F.max("place").over(by_part))
    # In a part, place min_docs has enough documents before it; places before that are open if there are other parts.
    sure = F.when(F.col("split"), F.col("place") >= min_docs).otherwise((F.col("place") > 1) & (F.col("docs") >= min_docs))
    ranked = ranked.withColumn("sure", sure).where(F.col("sure") | F.col("split"))
    # What is decided is dealt out by its document, what is open by its hash: it has min_docs - 1 documents a part at most.
    spread = F.when(F.col("sure"), F.xxhash64("row_key", "position")).otherwise(F.lit(0))
    by_hash = Window.partitionBy("h1", "h2", "spread")
    merged = ranked.withColumn("spread", spread).withColumn("last", F.dense_rank().over(by_hash.orderBy(last_first)))
    merged = merged.withColumn("all", F.greatest(F.max("last").over(by_hash), F.max("docs").over(by_hash)))
    return merged.where(F.col("sure") | ((F.col("last") > 1) & (F.col("all") >= min_docs))).select("row_key", "position")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, prefixes: int = PREFIXES, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, text) -> row_key, kept: the words of a document's bitmap in which a line is lost.

    kept is sorted by word (line position div 64); of its 64 bits, bit (position mod 64) is 1 if the line
    stays. Words that are absent keep all their lines; documents that lose nothing have no row.
    """
    lost = lost_lines(long_lines(docs, min_chars), min_docs, prefixes, part_rows)
    bit = F.expr("shiftleft(1L, position % 64)")
    words = lost.groupBy("row_key", F.expr("position div 64").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("kept"))


def _all_words(kept: str) -> Column:
    """The bitmap with the words that are absent before its last one."""
    gap = lambda x, i: x["word"] - F.when(i > 0, F.get(kept, i - 1)["word"] + 1).otherwise(0)
    return F.flatten(F.transform(kept, lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(x, i)), F.array(x["bits"]))))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, prefixes: int = PREFIXES, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_lines, n_dropped, kept (as in ``keep_bitmaps``, null if all stay), text without the lost lines.

    One row per row. A null or empty text is one empty line. Rows of one id are one document; a null id
    is an id, smaller than all others. Other columns are ignored; an empty table gives no rows.
    """
    kept = keep_bitmaps(docs, min_chars, min_docs, prefixes, part_rows).withColumnRenamed("row_key", "kept_key")
    rows = docs.select("doc_id", "text", _row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    joined = rows.join(kept.hint("shuffle_hash"), F.col("row_key") == F.col("kept_key"), "left")
    lost = F.aggregate("kept", F.lit(0).cast("long"), lambda n, x: n + 64 - F.bit_count(x["bits"]))
    parts = once(joined, ["doc_id", "kept", "text"], lines=_lines_of(F.col("text")), words=_all_words("kept"), n_dropped=F.coalesce(lost, F.lit(0).cast("long")))
    stays = lambda _, k: F.coalesce(F.getbit(F.get("words", F.floor(k / 64).cast("int")), k % 64), F.lit(1)) == 1
    text = F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter("lines", stays), "\n"))
    return parts.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "n_dropped", "kept", text.alias("text"))


def line_dedup_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_lines, n_dropped, kept_sha256."""
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same digests for DuckDB over a table {docs} of doc_id, text.
LINES_SQL = r"""
with lines as (
  select doc_id, row_of, unnest(parts) as line, generate_subscripts(parts, 1) as position
  from (select doc_id, row_number() over () as row_of, string_split(coalesce(text, ''), chr(10)) as parts from {docs})
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), repeated as (
  select key, max(doc_id) as last_doc from keyed where length(key) >= 20 group by key
  having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= 3
), judged as (
  select k.*, r.key is not null and k.doc_id is distinct from r.last_doc as lost from keyed k left join repeated r on k.key = r.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where lost)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by position) filter (where not lost), '')) as kept_sha256
from judged group by doc_id, row_of
"""
