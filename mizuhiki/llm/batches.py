"""Small Arrow batches, so that what a worker makes of a batch stays small beside the batch itself."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS, BYTES = 500, 8 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: int | None = None, rows: int = ROWS, limit: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, whose `column` of strings or bytes holds at most `limit` bytes; a longer
    value is a batch by itself."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) if column is not None else np.zeros(b.num_rows, np.int64)
        start = 0
        while start < b.num_rows:
            before = upto[start - 1] if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(upto, before + limit, "right"))))
            yield b.slice(start, end - start)
            start = end
