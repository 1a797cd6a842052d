"""Count-min sketches of 64-bit keys: one for each task, merged, and read by every task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fadegraph.llm.shared import binaries, mix, tidy

ROWS = 2
# Cells in a row at most; the merged sketch takes ROWS * MAX_WIDTH bits.
MAX_WIDTH = 1 << 28
_CHUNK = 1 << 20
_SALTS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
# Keys that a task sketches at a time.
_FLUSH = 1_000_000

Keys = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def _cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(keys ^ _SALTS[row]) & np.uint64(width - 1)).astype(np.int64)


def _flush(found: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """Cells that were reached once, and those reached again, by row and chunk of cells."""
    keys = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    for row in range(ROWS if len(keys) else 0):
        cells, counts = np.unique(_cells(keys, row, width), return_counts=True)
        edges = np.searchsorted(cells, np.arange(0, width + _CHUNK, _CHUNK))
        chunks = np.flatnonzero(np.diff(edges))
        once, again = [], []
        for chunk in chunks:
            part = slice(edges[chunk], edges[chunk + 1])
            local, more = (cells[part] - chunk * _CHUNK).astype(np.int32), counts[part] > 1
            once.append(local[~more].tobytes())
            again.append(local[more].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(chunks), row), pa.int32()), pa.array(chunks, pa.int32()), binaries(once), binaries(again)],
            ["line", "chunk", "once", "again"])


def _sketch_task(keys_of: Keys, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            for keys in keys_of(batch):
                found.append(keys)
                if sum(map(len, found)) > _FLUSH:
                    yield from _flush(found, width)
                    found = []
        yield from _flush(found, width)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the tasks' sketches, kept as one bit a cell: reached more than once.

    Rows come ordered by row and chunk, so one dense chunk is held at a time.
    """
    key, counts = None, np.zeros(_CHUNK, dtype=np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), binaries([np.packbits(counts > 1).tobytes()])],
            ["line", "chunk", "bits"])

    for batch in batches:
        for row in batch.to_pylist():
            at = (row["line"], row["chunk"])
            if at != key:
                if key is not None:
                    yield done()
                key = at
                counts[:] = 0
            once = np.frombuffer(row["once"], dtype=np.int32)
            counts[once] = np.minimum(counts[once] + 1, 2)
            counts[np.frombuffer(row["again"], dtype=np.int32)] = 2
    if key is not None:
        yield done()


class Repeated:
    """Which keys may occur more than once; never wrong about a key that does."""

    def __init__(self, lines: list[np.ndarray], width: int):
        self.lines, self.width = lines, width

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        often = np.ones(len(keys), dtype=bool)
        for row, bits in enumerate(self.lines):
            cells = _cells(keys, row, self.width)
            often &= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        return often


def width_for(n_keys: float) -> int:
    """Cells in a row: four to eight for each key, a power of two, within bounds."""
    return int(min(MAX_WIDTH, max(_CHUNK, 1 << int(4 * n_keys).bit_length())))


def repeated_keys(rows: DataFrame, keys_of: Keys, n_keys: float) -> Repeated:
    """The merged sketch of the keys that ``keys_of`` finds in batches of ``rows``.

    About ``n_keys`` are expected; more only make it less sharp.
    """
    width = width_for(n_keys)
    parts = rows.mapInArrow(tidy(_sketch_task(keys_of, width)), "line int, chunk int, once binary, again binary")
    n = max(1, min(ROWS * width // _CHUNK, 512))
    merged = (parts.repartition(n, "line", "chunk").sortWithinPartitions("line", "chunk")
              .mapInArrow(tidy(_merge), "line int, chunk int, bits binary"))
    lines = [np.zeros(width // 8, dtype=np.uint8) for _ in range(ROWS)]
    for row in merged.collect():  # at most ROWS * MAX_WIDTH bits
        bits = np.frombuffer(row["bits"], dtype=np.uint8)
        lines[row["line"]][row["chunk"] * _CHUNK // 8:][:len(bits)] = bits
    return Repeated(lines, width)
