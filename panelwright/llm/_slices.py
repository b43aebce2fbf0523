"""Small parts of Arrow batches, so that texts are Python objects a few at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows, and bytes of text, of a slice; a longer text is a slice of its own.
ROWS, BYTES = 512, 8 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, before + BYTES, side="right"))))
            yield batch.slice(at, end - at)
            at = end
