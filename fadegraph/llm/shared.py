"""Written tables and whole-text helpers that the operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.session import ensure_checkpoint_dir

# Bytes of text that one vectorised step works on; a longer text is one step of its own.
STEP_BYTES = 1_000_000
NO_ID = 2**63 - 1


def write_out(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder, read back from there.

    Compressed and columnar, unlike a checkpoint; every task can be run again
    from it after executors are lost.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(task):
    """The task, which at its end gives memory that its allocators kept back to the machine.

    Python workers are reused, and several share an executor's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def id_or_last(column: str) -> F.Column:
    """A 64-bit id; a null id counts as the largest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_or_null(column: str) -> F.Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


class Texts:
    """UTF-8 bytes of some whole texts, one after the other.

    ``data`` holds the bytes, text i is ``data[starts[i]:starts[i + 1]]``, and
    ``rows`` are the texts' places in their batch.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, rows: np.ndarray):
        self.data, self.starts, self.rows = data, starts, rows

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word, split at the six ASCII blanks."""
        inside = (self.data > 32) | (self.data < 9) | ((self.data > 13) & (self.data < 32))
        n = len(inside)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty(n, dtype=bool)
        after[-1], after[:-1] = False, inside[1:]
        edges = self.starts[:-1][self.starts[:-1] < n]
        before[edges] = False
        after[edges[edges > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        counts = np.diff(np.searchsorted(starts, self.starts))
        return starts, ends, np.repeat(np.arange(len(counts)), counts)


def texts_of(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[Texts]:
    """A string column in steps of bounded size, nulls as empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step_bytes, side="right")) - 1)
        to = min(to, len(column))
        yield Texts(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], np.arange(at, to))
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE_KEYS = np.random.default_rng(20_240_501).integers(0, 2**64, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_KEPT_POWERS = 1 << 21
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the usual step size."""
    if _powers and n <= len(_powers[0]):
        return _powers
    found = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        row = np.full(max(n, 1), base, dtype=np.uint64)
        row[0] = 1
        found.append(np.multiply.accumulate(row))
    if n <= _KEPT_POWERS:
        _powers[:] = found
    return found


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each of the ordered, disjoint byte spans, by sums of prefixes.

    ``table`` maps a byte to the one it counts as (for case folding).
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    powers, inverse = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(np.take(_BYTE_KEYS if table is None else _BYTE_KEYS[table], data) * powers[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def runs_hashes(words: np.ndarray, k: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes, by doubling."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    total, total_size, block, size, left = None, 0, words, 1, k
    n = len(words) - k + 1
    while left:
        if left & 1:
            if total is None:
                total, total_size = block, size
            else:
                factor = np.uint64(pow(base, size, 2**64))
                m = min(len(total), len(block) - total_size)
                total = total[:m] * factor + block[total_size:total_size + m]
                total_size += size
        left >>= 1
        if left:
            factor = np.uint64(pow(base, size, 2**64))
            block = block[:-size] * factor + block[size:]
            size *= 2
    return mix(total[:n])


def sliding_min(values: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each run of ``k`` values."""
    size, block = 1, values
    while size * 2 <= k:
        block = np.minimum(block[:-size], block[size:])
        size *= 2
    return np.minimum(block[:len(values) - k + 1], block[k - size:]) if len(values) >= k else values[:0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
