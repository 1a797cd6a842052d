"""Comparing many vectors with many, block by block.

Spark decides which rows meet; numpy multiplies the blocks that met.  No pair
of rows is ever a Spark row: what leaves a block is what the operator keeps of
it (the best k per query, a count, a spanning set of links), so the output
grows with the rows and not with the pairs.

Two ways bring rows together, both exact:

* the smaller side is broadcast, after it was counted and found within
  ``SimilarityLimits``;
* otherwise both sides are partitioned into cells around sampled pivot vectors.
  On unit vectors the distance is a metric, so a row needs to visit only the
  cells whose nearest point can lie within its search radius.  Cells are packed
  into blocks, a cell larger than a block is split into several, and each (block
  of the base, block of visitors) is a group of its own.  A row is sent once to
  a block, however many of its cells it visits, and there are at most about
  ``_WAYS`` blocks to a side until blocks reach ``_BLOCK_BYTES``, so what is
  shuffled grows with the rows and not with their pairs.  Where visitors go to
  few cells, as many groups come from the base alone, and it is sent once.
  Where a set is compared with itself, a group is two blocks of it, and a row is
  sent once to each block that it meets, not once as base and once as visitor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fadegraph.config import SimilarityLimits

# Rows of one tile of the similarity matrix times its columns.
_TILE_CELLS = 4_000_000
# Rows and columns of a tile of single precision, which stays in a core's cache.
_SCREEN_ROWS, _SCREEN_COLS = 512, 1_024
# Of the pairs of a tile that pass the screen, the share from which on all of it is multiplied again.
_DENSE = 1 / 16
# Visitors that are compared together with all cells any of them visits, at least.
_MEET_ROWS = 2_048
# Blocks that either side is cut into, if none is below ``block_rows`` or above ``_BLOCK_BYTES`` of vectors.
_WAYS = 4
# Blocks of a set that is compared with itself: 15 pairs of blocks, about as many groups as ``_WAYS`` blocks to a side make.
_OWN_WAYS = 5
_BLOCK_BYTES = 64 << 20
# Slack for rounding when a cell is ruled out by its distance bound.
_SLACK = 1e-6

SIDE_SCHEMA = "id string, ord long, value double, vec array<double>"


def side(df: DataFrame, id_: str | Column, vec: str | Column, ord_: Column | None = None,
         value: Column | None = None) -> DataFrame:
    """Rows prepared for comparison: (id, ord, value, vec).

    Vectors without length (all zero, or not numbers) have no direction; they
    are left out, so nothing is ever similar to them.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    squares = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    out = df.select(
        as_col(id_).cast("string").alias("id"),
        (F.lit(0) if ord_ is None else ord_).cast("long").alias("ord"),
        (F.lit(0.0) if value is None else value).cast("double").alias("value"),
        as_col(vec).cast("array<double>").alias("vec"),
    )
    return out.filter(squares.between(F.lit(np.finfo(float).tiny), F.lit(np.finfo(float).max)))


@dataclass
class Block:
    """Rows of one side, as arrays."""

    id: np.ndarray
    ord: np.ndarray
    value: np.ndarray
    vec: np.ndarray
    norm: np.ndarray
    # Worked out when first used: rows of length 1 in single precision, and the places of the names (``number_names``).
    unit: np.ndarray | None = None
    place: np.ndarray | None = None
    numbering: object = None

    def __len__(self) -> int:
        return len(self.id)

    def units(self) -> np.ndarray:
        if self.unit is None:
            self.unit = (self.vec / self.norm[:, None]).astype(np.float32)
        return self.unit

    @staticmethod
    def read(batch: pa.RecordBatch | pa.Table) -> "Block":
        """Rows in order of (ord, id), so that the first of equals is the one to keep."""
        return Block.ordered(batch)[0]

    @staticmethod
    def ordered(batch: pa.RecordBatch | pa.Table) -> tuple["Block", np.ndarray]:
        """The rows as ``read`` has them, and their places in the batch."""
        ids = np.asarray(batch.column("id").to_pylist(), dtype=object)
        ords = np.asarray(batch.column("ord"), dtype=np.int64)
        values = np.asarray(batch.column("value"), dtype=np.float64)
        vectors = batch.column("vec")
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.combine_chunks()
        flat = np.asarray(vectors.flatten(), dtype=np.float64)
        if len(ids) and len(flat) % len(ids):
            raise ValueError("vectors differ in width")
        matrix = flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
        order = np.lexsort((ids.astype(str), ords)) if len(ids) else np.zeros(0, dtype=int)
        matrix = matrix[order]
        return Block(ids[order], ords[order], values[order], matrix, np.sqrt((matrix * matrix).sum(axis=1))), order

    def take(self, rows) -> "Block":
        unit, place = (None if part is None else part[rows] for part in (self.unit, self.place))
        return Block(self.id[rows], self.ord[rows], self.value[rows], self.vec[rows], self.norm[rows], unit, place, self.numbering)

    def tiles(self, width: int) -> Iterator["Block"]:
        step = max(1, _TILE_CELLS // max(1, width))
        for start in range(0, len(self), step):
            yield self.take(slice(start, start + step))


def similarities(left: Block, right: Block) -> np.ndarray:
    """Cosine of each row of ``left`` with each of ``right``.

    Rounded to 12 digits, so that equal vectors tie whatever block they met in.
    """
    if left.vec.shape[1] != right.vec.shape[1]:
        raise ValueError("vectors differ in width")
    raw = (left.vec @ right.vec.T) / np.outer(left.norm, right.norm)
    return np.clip(np.round(raw, 12), -1.0, 1.0)


def pair_similarities(left: Block, right: Block, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """``similarities`` of some pairs only."""
    raw = np.empty(len(rows))
    for start in range(0, len(rows), _MEET_ROWS):
        r, c = rows[start:start + _MEET_ROWS], cols[start:start + _MEET_ROWS]
        raw[start:start + _MEET_ROWS] = np.einsum("ij,ij->i", left.vec[r], right.vec[c]) / (left.norm[r] * right.norm[c])
    return np.clip(np.round(raw, 12), -1.0, 1.0)


def screened(left: Block, right: Block, bar: np.ndarray, k: int = 0,
             earlier: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (rows, columns, similarities) that hold all whose similarity reaches the ``bar`` of their row, tile by tile.

    All pairs are multiplied in single precision.  Its error is bounded, so what stays
    below the bar by more than that needs no second look; the others are multiplied
    again in double precision.  The caller may raise bars between tiles.  With ``k`` a row needs
    its k best only, and a bar of minus infinity is raised to what the tile holds.
    ``earlier`` leaves out columns whose ord is not below the row's; columns are in order of ord.
    """
    if left.vec.shape[1] != right.vec.shape[1]:
        raise ValueError("vectors differ in width")
    # Rounding of both vectors and of each step of their product, and of the 12 digits.
    margin = (left.vec.shape[1] + 16) * 2.0**-23 + 1e-11
    rows_of, cols_of = left.units(), right.units()
    lowest = np.float32(-np.inf)
    for top in range(0, len(left), _SCREEN_ROWS):
        tile = slice(top, top + _SCREEN_ROWS)
        ords = left.ord[tile]
        for start in range(0, len(right), _SCREEN_COLS):
            part = slice(start, start + _SCREEN_COLS)
            if earlier and right.ord[start] >= ords.max():
                break
            scores = rows_of[tile] @ cols_of[part].T
            if earlier and right.ord[part][-1] >= ords.min():
                scores[right.ord[part][None, :] >= ords[:, None]] = lowest
            limit = np.nextafter((bar[tile] - margin).astype(np.float32), lowest)
            best = scores.max(axis=1)
            hit = np.flatnonzero((best >= limit) & (best > lowest))
            if not len(hit):
                continue
            near, limit = scores[hit], limit[hit]
            if k and k < near.shape[1] and np.count_nonzero(near >= limit[:, None]) > 4 * k * len(hit):
                kth = np.partition(near, near.shape[1] - k, axis=1)[:, -k]
                limit = np.maximum(limit, np.nextafter((kth - 2 * margin).astype(np.float32), lowest))
            rows, cols = np.nonzero((near >= limit[:, None]) & (near > lowest))
            if len(rows) > _DENSE * near.size:
                found = similarities(left.take(top + hit), right.take(part))[rows, cols]
                yield top + hit[rows], start + cols, found
            else:
                rows, cols = top + hit[rows], start + cols
                yield rows, cols, pair_similarities(left, right, rows, cols)


def number_names(*blocks: Block) -> None:
    """Give the rows of all blocks the place of their id in the order of names; equal ids share one."""
    place, numbering, start = np.unique(np.concatenate([b.id for b in blocks]).astype(str), return_inverse=True)[1], object(), 0
    for block in blocks:
        block.place, block.numbering = place[start:start + len(block)], numbering
        start += len(block)


def name_places(left: Block, right: Block) -> tuple[np.ndarray, np.ndarray]:
    """The places of both blocks' ids in one order of names."""
    if left.place is None or left.numbering is not right.numbering:
        left, right = left.take(slice(None)), right.take(slice(None))
        number_names(left, right)
    return left.place, right.place


# What a block keeps: called with two blocks, yields columns of the result.
Kernel = Callable[[Block, Block], pa.RecordBatch]


def whole_blocks(kernel: Kernel) -> Kernel:
    """Marks a kernel that holds no matrix of all pairs of its blocks; others are given tiles."""
    kernel.whole = True
    return kernel


def _kept(kernel: Kernel, left: Block, right: Block) -> Iterator[pa.RecordBatch]:
    for part in [left] if getattr(kernel, "whole", False) else left.tiles(len(right)):
        yield kernel(part, right)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    pairs = (part.split() for part in ddl.split(","))
    return pa.schema([(name, kinds[kind]) for name, kind in pairs])


def result_batch(ddl: str, *columns) -> pa.RecordBatch:
    schema = _arrow_schema(ddl)
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def fetch_if_small(rows: DataFrame, limits: SimilarityLimits) -> Block | None:
    """The side as one block when its size is within the limits, else None.

    The rows are counted first, up to the limit; no vector leaves the executors
    before that.
    """
    bound = limits.broadcast_rows
    size = rows.select(F.size("vec").alias("width")).limit(bound + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max("width"), F.lit(0)).alias("width")).first()
    if size["n"] > bound or size["n"] * size["width"] * 8 > limits.broadcast_bytes:
        return None
    table = rows.limit(bound + 1).toArrow()
    return None if table.num_rows > bound else Block.read(table)


def against_broadcast(left: DataFrame, right: Block, kernel: Kernel, ddl: str) -> DataFrame:
    """Run ``kernel`` on each batch of ``left`` and the broadcast ``right``."""
    shared = left.sparkSession.sparkContext.broadcast(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for batch in batches:
            if batch.num_rows and len(base):
                yield from _kept(kernel, Block.read(batch), base)

    return left.mapInArrow(run, ddl)


@dataclass(frozen=True)
class Cells:
    """Pivots and, per cell, its number of rows and its reach."""

    pivots: np.ndarray
    counts: np.ndarray
    reach: np.ndarray


def _unit(block: Block) -> np.ndarray:
    return block.vec / block.norm[:, None]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors @ pivots.T)))


def partition_base(base: DataFrame, limits: SimilarityLimits) -> tuple[DataFrame, Cells]:
    """Give each base row its cell.

    Pivots are base rows picked by a hash of the id: repeatable, spread over
    the data, and at most ``max_cells``.
    """
    wanted = max(1, min(limits.max_cells, math.ceil(base.count() / limits.block_rows)))
    picked = Block.read(base.orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow())
    pivots = np.unique(np.round(_unit(picked), 9), axis=0)
    return assign_cells(base, pivots / np.sqrt((pivots * pivots).sum(axis=1))[:, None])


def assign_cells(base: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, Cells]:
    """Base rows with the cell of their nearest pivot and the distance to it; pivots have length 1."""
    shared = base.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType(base.schema.fields + [
        T.StructField("cell", T.LongType()), T.StructField("gap", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = np.asarray(batch.column("vec").flatten(), dtype=np.float64)
            matrix = flat.reshape(batch.num_rows, -1)
            matrix = matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]
            gaps = _distances(matrix, shared.value)
            home = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home, type=pa.int64()), pa.array(gaps.min(axis=1))], names=names)

    placed = base.mapInArrow(assign, schema)
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("reach")).collect()
    counts, reach = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    for row in stats:
        counts[row["cell"]], reach[row["cell"]] = row["n"], row["reach"]
    return placed, Cells(pivots, counts, reach)


def _pack_bits(visits: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.packbits(visits, axis=1)], type=pa.binary())


def _bits(visited: pa.Array | pa.ChunkedArray, n_cells: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(visited.to_pylist()), dtype=np.uint8)
    return np.unpackbits(packed.reshape(len(visited), -1), axis=1)[:, :n_cells].astype(bool)


def pack_visits(visits: DataFrame, n_cells: int) -> DataFrame:
    """Visitors with the bits ``visited`` in place of their array ``cells``, which would grow with the number of cells."""
    kept = [c for c in visits.columns if c != "cells"]
    schema = T.StructType([visits.schema[c] for c in kept] + [T.StructField("visited", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column("cells")
            bits = np.zeros((batch.num_rows, n_cells), dtype=bool)
            bits[np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten())] = True
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _pack_bits(bits)], names=schema.names)

    return visits.mapInArrow(run, schema)


def cells_visited(visits: DataFrame, n_cells: int) -> list[int]:
    """The cells that some visitor visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_cells, dtype=bool)
        for batch in batches:
            if batch.num_rows:
                seen |= _bits(batch.column("visited"), n_cells).any(axis=0)
        yield result_batch("cell long", np.flatnonzero(seen))

    return sorted(r[0] for r in visits.select("visited").mapInArrow(run, "cell long").distinct().collect())


def visit_cells(left: DataFrame, cells: Cells, radius: Column | None) -> DataFrame:
    """Visitors with the bits ``visited`` of the cells they must visit.

    ``radius`` is the Euclidean distance between unit vectors within which the
    visitor looks; None visits the home cell only.
    """
    shared = left.sparkSession.sparkContext.broadcast(cells)
    source = left.withColumn("radius", (F.lit(-1.0) if radius is None else radius).cast("double"))
    schema = T.StructType(left.schema.fields + [T.StructField("visited", T.BinaryType())])
    kept = left.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = shared.value
        between = _distances(info.pivots, info.pivots)
        occupied = info.counts > 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = np.asarray(batch.column("vec").flatten(), dtype=np.float64)
            matrix = flat.reshape(batch.num_rows, -1)
            matrix = matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]
            look = np.asarray(batch.column("radius"), dtype=np.float64)[:, None]
            gaps = _distances(matrix, info.pivots)
            home = np.where(occupied, gaps, np.inf).argmin(axis=1)
            nearest = gaps.argmin(axis=1)
            # Nothing of a cell is nearer than the plane that parts it from the
            # visitor's own cell, nor nearer than its outermost row.
            apart = between[nearest]
            own = gaps[np.arange(len(gaps)), nearest][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 0, (gaps * gaps - own * own) / (2 * apart), 0.0)
            bound = np.maximum(np.maximum(plane, gaps - info.reach[None, :]), 0.0)
            visits = (bound <= look + _SLACK) & occupied & (look >= 0)
            lone = look[:, 0] < 0
            visits[lone, home[lone]] = occupied[home[lone]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _pack_bits(visits)], names=[*kept, "visited"])

    return source.mapInArrow(run, schema)


def _block_rows(count: int, width: int, limits: SimilarityLimits, ways: int = _WAYS) -> int:
    """Rows of one block of a side of ``count`` rows that is cut into about ``ways``."""
    return max(limits.block_rows, min(math.ceil(count / ways), _BLOCK_BYTES // (8 * max(1, width))))


def _pack_cells(counts: list[int], per_block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells share one, a large one has several of its own."""
    n = np.array(counts, dtype=np.int64)
    small = n <= per_block
    shared = np.where(small, n, 0)
    first = ((np.cumsum(shared) - shared + shared / 2) // per_block).astype(np.int64)
    parts = np.maximum(1, -(-n // per_block))
    own = np.where(small, 0, parts)
    return np.where(small, first, first[small].max(initial=-1) + 1 + np.cumsum(own) - own), parts


def _by_cell(values: np.ndarray) -> Column:
    at = F.array(*[F.lit(int(n)) for n in values])
    return F.element_at(at, (F.col("cell") + 1).cast("int"))


def _home_block(first: np.ndarray, parts: np.ndarray) -> Column:
    return (_by_cell(first) + F.pmod(F.xxhash64("id"), _by_cell(parts))).cast("int")


def _to_blocks(visits: DataFrame, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """One row per visitor and block that holds a cell it visits, with ``base_block``."""
    schema = T.StructType(visits.schema.fields + [T.StructField("blocks", T.ArrayType(T.IntegerType()))])
    holds = np.zeros((len(first), int((first + parts).max())), dtype=bool)
    for cell, (at, n) in enumerate(zip(first, parts, strict=True)):
        holds[cell, at:at + n] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            bits = _bits(batch.column("visited"), len(holds))
            blocks = [np.flatnonzero(b).astype(np.int32) for b in bits.astype(np.int32) @ holds.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, type=pa.list_(pa.int32()))], names=schema.names)

    return visits.mapInArrow(run, schema).withColumn("base_block", F.explode("blocks")).drop("blocks")


@dataclass(frozen=True)
class _Deal:
    """Blocks of the cells, visitors sent to them, and the number of blocks that the visitors of each are cut into."""

    first: np.ndarray
    parts: np.ndarray
    guests: DataFrame
    visit_blocks: np.ndarray
    rows_sent: int


def _deal(visits: DataFrame, cells: Cells, limits: SimilarityLimits, base_ways: int, visit_ways: int) -> _Deal:
    width, n_base = cells.pivots.shape[1], int(cells.counts.sum())
    first, parts = _pack_cells(cells.counts.tolist(), _block_rows(n_base, width, limits, base_ways))
    guests = _to_blocks(visits, first, parts)
    visitors = np.zeros(int((first + parts).max()), dtype=np.int64)
    for row in guests.groupBy("base_block").count().collect():
        visitors[row["base_block"]] = row["count"]
    per_visit = _block_rows(int(visitors.max()), width, limits, visit_ways)
    visit_blocks = np.maximum(1, -(-visitors // per_visit))
    held = np.zeros(len(visitors))  # rows of the base in each block
    for at, n, count in zip(first, parts, cells.counts, strict=True):
        held[at:at + n] += count / n
    return _Deal(first, parts, guests, visit_blocks, int(visitors.sum() + (held * visit_blocks).sum()))


def _meetings(visited: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the visitors and of the base that meet: visitors of like cells together, with all cells any of them visits."""
    present = np.unique(cell)
    wanted = visited[:, present]
    if wanted.all():
        yield np.arange(len(wanted)), np.arange(len(cell))
        return
    order = np.lexsort(np.packbits(wanted, axis=1).T)
    step = max(_MEET_ROWS, _TILE_CELLS // max(1, len(cell)))
    for start in range(0, len(order), step):
        rows = order[start:start + step]
        yield rows, np.flatnonzero(np.isin(cell, present[wanted[rows].any(axis=0)]))


def against_cells(visits: DataFrame, placed: DataFrame, cells: Cells, kernel: Kernel, ddl: str,
                  limits: SimilarityLimits) -> DataFrame:
    """Run ``kernel`` on every (block of visitors, block of the base) that have to meet.

    ``visits`` has the bits ``visited`` of each visitor's cells.  Each base row is in one
    block, so a visitor meets it at most once.  The number of blocks follows
    from counts per cell and per block, tables of at most ``max_cells`` rows.
    Of many blocks of the base, to each of which its visitors go uncut, and
    ``_WAYS`` blocks to a side, those are taken that send fewer rows.
    """
    slim = visits.select("id", "ord", "value", "vec", "visited")
    dealt = _deal(slim, cells, limits, _WAYS * _WAYS, 1)
    if dealt.rows_sent > _WAYS * int(cells.counts.sum()):
        dealt = min(dealt, _deal(slim, cells, limits, _WAYS, _WAYS), key=lambda d: d.rows_sent)
    first, parts, guests = dealt.first, dealt.parts, dealt.guests
    ways = F.element_at(F.array(*[F.lit(int(n)) for n in dealt.visit_blocks]), F.col("base_block") + 1)
    at_home = placed.withColumn("base_block", _home_block(first, parts))
    met = at_home.select(
        "base_block", F.explode(F.sequence(F.lit(0), ways - 1)).alias("visit_block"), "id", "ord", "value", "vec",
        F.col("cell").cast("int").alias("cell"), F.lit(None).cast("binary").alias("visited"),
    ).unionByName(guests.select(
        "base_block", F.pmod(F.xxhash64("id"), ways).cast("int").alias("visit_block"), "id", "ord", "value", "vec",
        F.lit(-1).alias("cell"), "visited"))
    empty = _arrow_schema(ddl).empty_table()
    n_cells = len(cells.counts)

    def run(group: pa.Table) -> pa.Table:
        home = np.asarray(group.column("cell"))
        if not (home >= 0).any() or not (home < 0).any():
            return empty
        base, guests = group.filter(pa.array(home >= 0)), group.filter(pa.array(home < 0))
        right, base_at = Block.ordered(base)
        left, guest_at = Block.ordered(guests)
        visited = _bits(guests.column("visited"), n_cells)[guest_at]
        found = [kept for rows, cols in _meetings(visited, home[home >= 0][base_at]) if len(cols)
                 for kept in _kept(kernel, left.take(rows), right if len(cols) == len(right) else right.take(cols))]
        return pa.Table.from_batches(found) if found else empty

    return met.groupBy("base_block", "visit_block").applyInArrow(run, ddl)


def within_cells(visits: DataFrame, cells: Cells, kernel: Kernel, ddl: str, limits: SimilarityLimits,
                 across: Kernel | None = None) -> DataFrame:
    """Run ``kernel`` on every two blocks of one set that have to meet, both ways round.

    Two different blocks go to ``across`` instead, if given, and one way round only.

    ``visits`` are the rows of ``partition_base``, visiting.  Rows within each
    other's radius visit each other's cell, so a row goes to the pairs of its
    own block with those it visits, and meets there who visits it.
    """
    n, width = int(cells.counts.sum()), cells.pivots.shape[1]

    def dealt(ways: int) -> DataFrame:
        first, parts = _pack_cells(cells.counts.tolist(), _block_rows(n, width, limits, ways))
        own = visits.select("id", "ord", "value", "vec", F.col("cell").cast("int").alias("cell"), "visited",
                            _home_block(first, parts).alias("own_block"))
        return _to_blocks(own, first, parts)

    sent = dealt(_WAYS * _WAYS)
    # Rows that go to few blocks may have many; those that go to all are sent to fewer.
    if sent.count() > _OWN_WAYS * n:
        sent = dealt(_OWN_WAYS)
    met = sent.select(F.least("own_block", "base_block").alias("i"), F.greatest("own_block", "base_block").alias("j"),
                      "id", "ord", "value", "vec", "cell", "visited", "own_block")
    empty = _arrow_schema(ddl).empty_table()
    n_cells = len(cells.counts)

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        at = np.asarray(group.column("own_block"))
        sides = []
        for block in sorted({i, j}):
            rows = group.filter(pa.array(at == block))
            if not rows.num_rows:
                return empty
            own, places = Block.ordered(rows)
            sides.append((own, np.asarray(rows.column("cell"))[places], _bits(rows.column("visited"), n_cells)[places]))
        number_names(*(own for own, _, _ in sides))
        turns = [(sides[0], sides[0])] if i == j else [sides, sides[::-1]] if across is None else [sides]
        run_on = kernel if i == j or across is None else across
        found = []
        for (left, _, visited), (right, cell, _) in turns:
            found += [kept for rows, cols in _meetings(visited, cell) if len(cols)
                      for kept in _kept(run_on, left.take(rows), right if len(cols) == len(right) else right.take(cols))]
        return pa.Table.from_batches(found) if found else empty

    return met.groupBy("i", "j").applyInArrow(run, ddl)


def ways_of(count: int, width: int) -> int:
    """Blocks that a side of ``count`` vectors is cut into where every row of it goes to each block of the other."""
    return max(_WAYS, math.ceil(count * 8 * width / _BLOCK_BYTES))


def thin_copies(rows: DataFrame, keep: int) -> DataFrame:
    """At most the first ``keep`` rows, by (ord, id), of each distinct vector.

    A search that wants k rows never needs more than k of equal ones, and a
    large group of copies would otherwise be compared with itself.  Spark
    applies the row limit before the shuffle too, so the group is not gathered.
    """
    order = Window.partitionBy("vec").orderBy("ord", "id")
    return rows.withColumn("_copy", F.row_number().over(order)).filter(F.col("_copy") <= keep).drop("_copy")


def radius_of(similarity: float) -> float:
    """Distance between unit vectors whose cosine is ``similarity``."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * similarity))


def compare(left: DataFrame, right: DataFrame, kernel: Kernel, ddl: str, min_similarity: float,
            limits: SimilarityLimits) -> DataFrame:
    """Run ``kernel`` so that all pairs at or above ``min_similarity`` meet once."""
    base = fetch_if_small(right, limits)
    if base is not None:
        return against_broadcast(left, base, kernel, ddl)
    placed, cells = partition_base(right, limits)
    visits = visit_cells(left, cells, F.lit(radius_of(min_similarity)))
    return against_cells(visits, placed, cells, kernel, ddl, limits)


def compare_within(rows: DataFrame, kernel: Kernel, ddl: str, min_similarity: float, limits: SimilarityLimits,
                   across: Kernel | None = None) -> DataFrame:
    """``compare`` of a set with itself: all pairs at or above ``min_similarity`` meet (see ``within_cells``)."""
    base = fetch_if_small(rows, limits)
    if base is not None:
        return against_broadcast(rows, base, kernel, ddl)
    placed, cells = partition_base(rows, limits)
    return within_cells(visit_cells(placed, cells, F.lit(radius_of(min_similarity))), cells, kernel, ddl, limits, across)
