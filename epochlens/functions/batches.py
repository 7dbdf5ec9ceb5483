"""Arrow batches in slices of bounded bytes, so that a worker's scratch space does not depend on the size of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096


def value_bytes(arr: pa.Array) -> np.ndarray:
    """Bytes of the values of every row, those of lists and structs with all they hold."""
    kind = arr.type
    if pa.types.is_struct(kind):
        return sum((value_bytes(part) for part in arr.flatten()), np.zeros(len(arr), np.int64))
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        edge = np.concatenate([[0], np.cumsum(pc.list_value_length(arr).fill_null(0).to_numpy(zero_copy_only=False))])
        return np.diff(np.concatenate([[0], np.cumsum(value_bytes(arr.flatten()))])[edge.astype(np.int64)])
    if any(is_kind(kind) for is_kind in (pa.types.is_binary, pa.types.is_large_binary, pa.types.is_string, pa.types.is_large_string)):
        return pc.binary_length(arr).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(arr), 8, np.int64)


def row_slices(sizes: np.ndarray, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """(low, high) row ranges of at most ``limit`` bytes and ``rows`` rows each, or of one single larger row."""
    end = np.cumsum(sizes)
    low, before = 0, 0
    while low < end.size:
        high = min(max(int(np.searchsorted(end, before + limit, side="right")), low + 1), low + rows)
        yield low, min(high, end.size)
        low = min(high, end.size)
        before = int(end[low - 1])


def batch_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices that share its buffers."""
    sizes = sum((value_bytes(column) for column in batch.columns), np.zeros(batch.num_rows, np.int64))
    for low, high in row_slices(sizes, limit, rows):
        yield batch.slice(low, high - low)


def slices_of(batches, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from batch_slices(batch, limit, rows)
