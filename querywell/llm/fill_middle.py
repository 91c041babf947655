"""Fill-in-the-middle texts by rotating blocks of a byte array in place.

A text is cut into prefix, middle and suffix at the ends of its tokens. The
sentinels are inserted into one ``bytearray`` of its UTF-8 bytes, in the text's
own order: ``<P>prefix<M>middle<S>suffix``. Two neighbouring blocks of the array
then change places by three reversals, which needs no second array of blocks:
``psm`` turns the last two blocks, ``spm`` the last with all before it. The
inverse rotation and the removal of the sentinels restore the text.

Every row is rewritten by itself: no shuffle, no state, memory of one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P, M, S = b"<P>", b"<M>", b"<S>"
SEED, FIM_PERCENT, SPM_PERCENT, PART_BYTES = 42, 50, 80, 8 << 20


def rotate(block: bytearray, begin: int, cut: int, end: int) -> None:
    """Exchange block[begin:cut] and block[cut:end] where they lie: reverse each, then both."""
    for a, b in ((begin, cut), (cut, end), (begin, end)):
        block[a:b] = block[a:b][::-1]


def token_ends(text: bytes) -> np.ndarray:
    """Byte offsets at which the tokens of a UTF-8 text end.

    A token is a word with the white space before it, or the white space at the
    end. White space is ASCII, so no byte of a longer character is taken for it.
    """
    codes = np.frombuffer(text, dtype=np.uint8)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(codes)) if len(codes) else ends


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers of a document; a null id is the empty string."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def points(text: bytes) -> int:
    """Code points of a UTF-8 text."""
    return int(np.count_nonzero(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80))


def transformed(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text with its blocks [:first], [first:second], [second:] in the order of ``form``."""
    block = bytearray(text)
    block[second:second] = S
    block[first:first] = M
    block[0:0] = P
    middle, suffix = first + len(P), second + len(P) + len(M)
    rotate(block, 0 if form == "spm" else middle, suffix, len(block))
    return block


def restored(output: bytes, form: str) -> bytes:
    """The exact text of ``transformed``; a text that holds no sentinel of its own comes back as it was."""
    if form == "plain":
        return bytes(output)
    block = bytearray(output)
    if form == "spm":
        rotate(block, 0, block.index(P), len(block))
    else:
        suffix = block.index(S)
        rotate(block, suffix, block.index(M, suffix), len(block))
    middle = block.index(M)
    suffix = block.index(S, middle)
    del block[suffix : suffix + len(S)], block[middle : middle + len(M)], block[: len(P)]
    return bytes(block)


def fill_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output; one row per row.

    n counts tokens. Both cuts are drawn from the id alone, so reruns agree and rows of one id and
    text are alike. A null text is empty; an empty text and one that holds a sentinel stay ``plain``,
    with null lengths. A null id draws as the empty string. Other columns are ignored; an empty
    table gives no rows. Results leave in batches of about ``PART_BYTES`` of text, a longer one alone.
    """

    def row(doc_id: object, text: bytes) -> tuple:
        ends = token_ends(text)
        n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
        if not text or any(mark in text for mark in (P, S, M)) or h3 % 100 >= fim_percent:
            return doc_id, n, "plain", None, None, text
        form = "spm" if h4 % 100 < spm_percent else "psm"
        first, second = (int(ends[c - 1]) if c else 0 for c in sorted((h1 % (n + 1), h2 % (n + 1))))
        return doc_id, n, form, points(text[:first]), points(text[first:second]), bytes(transformed(text, first, second, form))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            made, held = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                made.append(row(doc_id.as_py(), (text.as_py() or "").encode()))
                held += len(made[-1][-1])
                if held >= PART_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)
                    made, held = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored_text(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text from which ``fill_middle`` made an output of a form; null if either is null."""

    @F.pandas_udf("string")
    def inverse(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restored(o.encode(), f).decode() for o, f in zip(outputs, forms)], dtype="object")

    return inverse(output, form)


def fill_middle_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored_text(), 256).alias("restored_sha256"))


#: The digests of the same transformation for DuckDB over a table {docs} of doc_id, text.
FIM_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as d,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens
  from {docs}
), drawn as (
  select *, len(tokens) as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4
  from cut
), formed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from drawn
), parts as (
  select *, array_to_string(tokens[1:a], '') as p, array_to_string(tokens[a + 1:b], '') as m, array_to_string(tokens[b + 1:n], '') as s
  from formed
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars,
  case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
