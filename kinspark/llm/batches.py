"""Parts of Arrow batches that fit in memory whatever the length of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(b: pa.RecordBatch, column: int, rows: int = 2000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``b`` in parts of up to ``rows`` rows and ``size`` bytes of text in ``column``; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < b.num_rows:
        used = ends[at - 1] if at else 0
        stop = min(max(int(np.searchsorted(ends, used + size, side="right")), at + 1), at + rows)
        yield b.slice(at, stop - at)
        at = stop
