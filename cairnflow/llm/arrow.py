"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that a task has in hand at once, unless one text is longer.
PART = 8 << 20


def parts(batch: pa.RecordBatch, column: int = 1, rows: int = 8192, most: int = PART) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about `most` bytes in a string or binary column."""
    c = batch.column(column)
    offsets = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1)
    a = 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        z = min(z, a + rows, batch.num_rows)
        yield batch.slice(a, z - a)
        a = z


def split(batches, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches in parts."""
    for batch in batches:
        yield from parts(batch, column)
