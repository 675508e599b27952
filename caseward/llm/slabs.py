"""Arrow helpers of the text operators: bounded slabs of rows, words as dictionary codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch sent to a worker; without a limit ten thousand texts make one.
BATCH_BYTES = 4 << 20
#: Text bytes handled at once inside a task; one longer text makes a slab of its own.
SLAB_BYTES = 4 << 20
#: XXH64-like constants of the 64-bit mixers; fixed values.
_MIX_1, _MIX_2, _MIX_3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def sizes_of(column: pa.Array) -> np.ndarray:
    """Bytes of each text, null: 0."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark cut Arrow batches at ``BATCH_BYTES``, unless the session names a limit itself."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: workers wait between tasks with what they hold."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def worker_table(name: str) -> dict:
    """A dictionary that lives as long as this Python worker, over its tasks."""
    import sys
    from types import ModuleType

    return sys.modules.setdefault("_caseward_worker", ModuleType("_caseward_worker")).__dict__.setdefault(name, {})


def slabs(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, regrouped to about ``limit`` bytes of text."""
    give_back()
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(sizes_of(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + limit - held, side="right"))
            stop = max(stop, start if kept else start + 1)
            if stop > start:
                kept.append(batch.slice(start, stop - start))
                held += int(ends[stop - 1] - base)
            start = stop
            if start < batch.num_rows or held >= limit:
                yield joined(kept)
                kept, held = [], 0
    if kept:
        yield joined(kept)
    kept = []
    give_back()


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[0], starts[0]+1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column of texts.

    codes: a number for each word in reading order; terms: the text of each
    number; starts: where the words of each row begin (one more entry than rows).
    """

    def __init__(self, column: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(real)])
        encoded = flat.filter(pa.array(real)).dictionary_encode()
        self.codes = encoded.indices.to_numpy().astype(np.int64)
        self.terms = encoded.dictionary
        self.starts = before[offsets - offsets[0]]
        self.counts = np.diff(self.starts)

    @property
    def rows(self) -> np.ndarray:
        """The row number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def mixed(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each ordered pair of 64-bit values."""
    x = a * _MIX_1 + np.uint64((salt * 2 + 1) * 0x27D4EB2F165667C5 & (1 << 64) - 1)
    x ^= x >> np.uint64(29)
    x = x + b * _MIX_2
    x ^= x >> np.uint64(32)
    x *= _MIX_3
    x ^= x >> np.uint64(30)
    return x


def window_hashes(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``width`` values from each position on.

    Hashes of doubling widths are combined; the last step overlaps.  Positions
    whose window would leave the array get no entry.
    """
    have = 1
    out = mixed(values, np.full(1, width, np.uint64), salt)
    while have < width:
        step = min(have, width - have)
        out = mixed(out[: len(out) - step], out[step:], salt + have)
        have += step
    return out


def term_hashes(terms: pa.Array, seed: int) -> np.ndarray:
    """XXH64 of each term's UTF-8 bytes."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(t, seed) for t in terms.cast(pa.binary()).to_pylist()), np.uint64, len(terms))
