"""Arrow batches of texts in parts of bounded size, so that a task's Python memory depends neither on the table nor on the texts of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a part.
BYTES = 1 << 21


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in parts of so many bytes of text at most; a longer text is a part by itself."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to
