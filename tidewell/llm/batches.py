"""Bounded slices of Arrow batches, so that a worker's memory follows the slice and not the batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Text bytes a slice holds; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES):
    """Consecutive slices of batch whose texts in `column` have about `limit` bytes at most."""
    texts = batch.column(column)
    if not len(texts):
        return
    total_bytes = _sizes(texts)
    total, start = 0, 0
    for i, n in enumerate(total_bytes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def _sizes(texts: pa.Array) -> np.ndarray:
    large = texts.cast(pa.large_string())
    return np.diff(np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset : large.offset + len(large) + 1])


def whole_groups(batches, keys: list[int]):
    """From batches sorted by `keys`, tables that hold whole groups only; what is carried over is one group at most.

    For bounded groups only: callers route larger ones another way.
    """
    carry = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([b])])
        change = changes(t, keys)
        if not len(change):
            carry = t
            continue
        last = int(change[-1])
        yield t.slice(0, last).combine_chunks()
        carry = t.slice(last).combine_chunks()
    if carry is not None and carry.num_rows:
        yield carry.combine_chunks()


def changes(t: pa.Table, keys: list[int]) -> np.ndarray:
    """Rows whose key differs from the row before."""
    differs = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        v = t.column(k).to_numpy()
        differs |= v[1:] != v[:-1]
    return np.flatnonzero(differs) + 1
