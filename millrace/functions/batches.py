"""Arrow batches in pieces, so that what Python holds follows from bytes and not from rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20


def _row_ends(values: pa.Array) -> np.ndarray:
    """Bytes up to the end of each row of an array of texts or of (nested) lists."""
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        offsets = np.asarray(values.offsets, dtype=np.int64)
        inner = values.values.slice(offsets[0], offsets[-1] - offsets[0])
        ends = np.concatenate([[0], _row_ends(inner)])[offsets[1:] - offsets[0]]
        return ends + 8 * (offsets[1:] - offsets[0])
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        width = np.int64 if pa.types.is_large_string(values.type) else np.int32
        offsets = np.frombuffer(values.buffers()[1], dtype=width, count=len(values) + 1 + values.offset)[values.offset :] if len(values) else np.zeros(1, width)
        return offsets[1:].astype(np.int64) - int(offsets[0])
    return 8 * np.arange(1, len(values) + 1, dtype=np.int64)


def row_cuts(columns: Iterable[pa.Array], size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Start and number of rows of pieces of at most about ``size`` bytes, or of one row."""
    columns = list(columns)
    rows, start, done = len(columns[0]), 0, 0
    ends = sum(_row_ends(c) for c in columns)
    while start < rows:
        stop = max(int(np.searchsorted(ends, done + size, side="right")), start + 1)
        yield start, stop - start
        start, done = stop, int(ends[stop - 1])
    if not rows:
        yield 0, 0


def slices(batches: Iterable[pa.Array], size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The batches, in pieces of at most about ``size`` bytes, or of one row."""
    for values in batches:
        for start, rows in row_cuts([values], size):
            yield values.slice(start, rows)
