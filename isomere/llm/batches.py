"""Slices of Arrow batches, so that what is turned into Python objects at once is bounded in bytes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text or data turned into Python objects at once; a longer value stands alone.
BYTES = 1 << 20


def by_bytes(batch: pa.RecordBatch, column: int = 0, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``BYTES`` bytes in a text or binary column."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, n = 0, batch.num_rows
    while at < n:
        base = int(total[at - 1]) if at else 0
        end = max(at + 1, min(n, at + rows, int(np.searchsorted(total, base + BYTES, side="right"))))
        yield batch.slice(at, end - at)
        at = end
