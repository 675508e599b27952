"""Arrow batches of whole groups, for tasks whose rows come ordered by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether each row begins a group (nulls are equal)."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for key in keys:
        codes = rows.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of whole groups, of about ``size`` rows or one larger group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < size:
            continue
        rows = pa.concat_batches(held)
        last = int(np.flatnonzero(changes(rows, keys))[-1])
        if last:
            yield rows.slice(0, last)
        held, count = [rows.slice(last)], rows.num_rows - last
    if held:
        yield pa.concat_batches(held)
