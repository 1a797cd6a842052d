"""Exact top-k search by inner product with two cover trees.

Vectors become integers, ``floor(scale * x)``.  Equal vectors are one item that
keeps the ids a top k can need.  Items lie in cells around sampled pivots; the
covering radius of a cell bounds every product with its items, and a query
visits the cells whose bound reaches its own kth score from a first visit to
one cell.  Where queries and items of a cell meet, both are indexed by a cover
tree, and pairs of nodes are cut off when their centres and covering radii
bound all their products below the worst kth score in the group of queries.

Cells and visiting queries are cut into blocks of bounded size, so a hot cell
is many tasks.  Search stays exact for any data; how much is cut off depends on
the data, and vectors spread evenly in many dimensions leave little to cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fadegraph.llm.shared import write_out

# Pivots around which cells are made, sampled by hash; the table of cells is as small as that.
PIVOTS = 64
BLOCK_ROWS = 4_096
LEAF = 64
FANOUT = 16
_LONG = 2**63 - 1
# Above this size products are no longer exact in double precision.
_EXACT = float(2**53)


@dataclass
class Node:
    """A node of a cover tree: its points lie within ``radius`` of ``centre``."""

    centre: np.ndarray
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Cover tree of the rows of ``x``: children are spread out at half the radius of their parent, as far as that many do."""
    points = np.arange(len(x)) if points is None else points
    own = x[points]
    centre = own[0]
    gap = np.sqrt(((own - centre) ** 2).sum(axis=1))
    radius = float(gap.max())
    node = Node(centre, radius, points)
    if len(points) <= leaf or radius == 0.0:
        return node
    nearest = np.zeros(len(points), dtype=np.int64)
    count = 1
    while count < FANOUT and gap.max() > radius / 2:
        far = int(gap.argmax())
        other = np.sqrt(((own - own[far]) ** 2).sum(axis=1))
        closer = other < gap
        nearest[closer], gap[closer] = count, other[closer]
        count += 1
    for c in range(count):
        part = points[nearest == c]
        if len(part) == len(points):
            return node
        if len(part):
            node.children.append(cover_tree(x, part, leaf))
    return node


def _bound(q: Node, d: Node) -> float:
    """No product of a point of ``q`` with one of ``d`` is larger."""
    value = float(q.centre @ d.centre) + q.radius * float(np.linalg.norm(d.centre)) + d.radius * float(
        np.linalg.norm(q.centre)) + q.radius * d.radius
    return value + 1e-9 * abs(value) + 1e-6


class _Search:
    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, items: np.ndarray, ids: list[np.ndarray], k: int):
        self.q, self.qid, self.floor, self.d, self.k = queries, query_ids, floors, items, k
        self.counts = np.array([len(i) for i in ids])
        self.firsts = np.cumsum(self.counts) - self.counts
        self.ids = np.concatenate(ids)
        top = np.abs(queries).max(initial=0.0) * np.abs(items).max(initial=0.0) * queries.shape[1]
        self.exact = top < _EXACT
        n = len(queries)
        self.rows = np.zeros(0, dtype=np.int64)
        self.scores, self.found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.kth = floors.copy()
        self.n = n

    def products(self, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.q[q] @ self.d[d].T).astype(np.int64)
        whole = np.array([[int(v) for v in row] for row in self.q[q]], dtype=object)
        other = np.array([[int(v) for v in row] for row in self.d[d]], dtype=object)
        return np.clip(whole @ other.T, -_LONG - 1, _LONG).astype(np.int64)

    def visit(self, q: Node, ds: list[Node]) -> None:
        """Search ``ds`` for the queries of ``q``, the most promising first."""
        bounds = [(_bound(q, d), d) for d in ds]
        worst = self.kth[q.points].min()
        bounds = sorted((b for b in bounds if b[0] >= worst), key=lambda b: -b[0])
        if q.children:
            deeper = [c for _, d in bounds for c in (d.children or [d])]
            for child in q.children:
                self.visit(child, deeper)
            return
        ready: list[np.ndarray] = []
        size = 0
        stack = [d for _, d in reversed(bounds)]
        while stack:
            d = stack.pop()
            if _bound(q, d) < self.kth[q.points].min():
                continue
            if d.children:
                stack.extend(sorted(d.children, key=lambda c: _bound(q, c)))
                continue
            ready.append(d.points)
            size += len(d.points)
            if size >= 1_024:
                self.settle(q.points, np.concatenate(ready))
                ready, size = [], 0
        if ready:
            self.settle(q.points, np.concatenate(ready))

    def settle(self, q: np.ndarray, d: np.ndarray) -> None:
        """Score queries against items and keep the best k ids of each, ties to the smaller id."""
        scores = self.products(q, d)
        kth = self.kth[q]
        if scores.shape[1] > self.k + 1:
            # The query's own row may be among them: the k + 1 best scores hold k others.
            part = np.partition(scores, scores.shape[1] - self.k - 1, axis=1)[:, scores.shape[1] - self.k - 1]
            kth = np.maximum(kth, part.astype(float))
        at, item = np.nonzero(scores >= kth[:, None])
        if not len(at):
            return
        picked, value = d[item], scores[at, item]
        n = self.counts[picked]
        row = np.repeat(q[at], n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ids = self.ids[np.repeat(self.firsts[picked], n) + inner]
        value = np.repeat(value, n)
        other = ids != self.qid[row]
        mine = np.isin(self.rows, q)
        rows = np.r_[self.rows[mine], row[other]]
        value, ids = np.r_[self.scores[mine], value[other]], np.r_[self.found[mine], ids[other]]
        order = np.lexsort((ids, -value.astype(float) if self.exact else [-int(v) for v in value], rows))
        rows, value, ids = rows[order], value[order], ids[order]
        first = np.searchsorted(rows, rows)
        place = np.arange(len(rows)) - first
        keep = place < self.k
        last = place == self.k - 1
        self.kth[rows[last]] = np.maximum(self.kth[rows[last]], value[last].astype(float))
        rows, value, ids = rows[keep], value[keep], ids[keep]
        self.rows = np.r_[self.rows[~mine], rows]
        self.scores, self.found = np.r_[self.scores[~mine], value], np.r_[self.found[~mine], ids]


def dual_tree(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, items: np.ndarray, ids: list[np.ndarray],
              k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` ids of each query, no worse than its floor: (query id, id, score)."""
    search = _Search(queries, query_ids, floors, items, ids, k)
    search.visit(cover_tree(queries), [cover_tree(items)])
    return query_ids[search.rows], search.found, search.scores


def _meet(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(items: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        if not len(items) or not len(visits):
            return pd.DataFrame({n: np.zeros(0, dtype=np.int64) for n in names})
        found = dual_tree(np.stack(visits["vec"].to_numpy()).astype(float), visits["query_id"].to_numpy(),
                          visits["least"].to_numpy(dtype=float).copy(), np.stack(items["vec"].to_numpy()).astype(float),
                          [np.asarray(i) for i in items["ids"]], k)
        return pd.DataFrame(dict(zip(names, found)))

    return run


@dataclass(frozen=True)
class Cells:
    """Pivots by dimension, with number, radius and blocks of their cells."""

    pivots: dict[int, np.ndarray]
    numbers: dict[int, np.ndarray]
    radius: dict[int, float] = field(default_factory=dict)
    blocks: dict[int, int] = field(default_factory=dict)


def _rows_by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of each width: width, places in the batch, matrix."""
    sizes = np.asarray(column.value_lengths())
    for width in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == width)
        flat = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
        yield width, places, flat.reshape(len(places), width).astype(float)


def _assign(cells) -> object:
    """Cell of the nearest pivot, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, gap = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for width, places, x in _rows_by_width(batch.column("vec")):
                pivots = cells.value.pivots.get(width)
                if pivots is None:
                    cell[places], gap[places] = -1 - width, np.linalg.norm(x, axis=1)
                    continue
                square = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)[None, :]
                near = square.argmin(axis=1)
                cell[places] = cells.value.numbers[width][near]
                gap[places] = np.linalg.norm(x - pivots[near], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], [*batch.schema.names, "cell", "gap"])

    return run


def _route(cells, first: bool):
    """Cells that a query visits: the one of the largest product with its pivot, or all that its floor does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cells.value
        for batch in batches:
            floors = batch.column("least").to_numpy(zero_copy_only=False)
            ids = batch.column("query_id").to_numpy(zero_copy_only=False)
            row_at, cell_at = [], []
            for width, places, x in _rows_by_width(batch.column("vec")):
                numbers = known.numbers.get(width, np.array([-1 - width]))
                pivots = known.pivots.get(width, np.zeros((1, width)))
                there = [i for i, c in enumerate(numbers.tolist()) if c in known.blocks]
                if not there:
                    continue
                numbers, pivots = numbers[there], pivots[there]
                products = x @ pivots.T
                if first:
                    row_at.append(places)
                    cell_at.append(numbers[products.argmax(axis=1)])
                    continue
                reach = products + np.linalg.norm(x, axis=1)[:, None] * np.array([known.radius[c] for c in numbers.tolist()])
                reach += 1e-9 * np.abs(reach) + 1e-6
                row, at = np.nonzero(reach >= floors[places][:, None])
                row_at.append(places[row])
                cell_at.append(numbers[at])
            row = np.concatenate(row_at) if row_at else np.zeros(0, dtype=np.int64)
            cell = np.concatenate(cell_at) if cell_at else np.zeros(0, dtype=np.int64)
            blocks = np.array([known.blocks[c] for c in cell.tolist()], dtype=np.int64)
            if first:
                salt = ids[row] // 50 % np.maximum(blocks, 1)
            else:
                salt = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                row, cell = np.repeat(row, blocks), np.repeat(cell, blocks)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(cell), pa.array(salt)],
                                             [*batch.schema.names, "cell", "salt"])

    return run


def _search_visits(items: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Items and the queries that visit their block meet in groups of bounded size."""
    crowds = visits.groupBy("cell", "salt").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("slices"))
    visits = visits.join(crowds, ["cell", "salt"]).withColumn("slice", F.pmod(F.xxhash64("query_id"), "slices")).drop("slices")
    there = items.join(crowds, ["cell", "salt"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    left = there.select("cell", "salt", "slice", "vec", "ids").groupBy("cell", "salt", "slice")
    right = visits.groupBy("cell", "salt", "slice")
    return left.cogroup(right).applyInPandas(_meet(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, scale: float = 256.0, id_: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """The ``k`` vectors of the largest integer inner product with each query: (query_id, rank, vec_id, score).

    Queries are the rows for which ``is_query``, a condition on ``vectors``,
    holds; candidates are all rows but the query's own.  Ties go to the smaller
    id; with fewer candidates all are returned.  Vectors that are null or hold
    null or non-finite components take no part, nor do rows without an id.
    Components and scores beyond 64 bits stop at the largest such number.
    Vectors of different width do not meet.  Rows that repeat an id are one
    item, with the least of their vectors.  Other columns are dropped.  An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    value = F.col(vector).cast("array<double>")
    usable = (F.col(id_).isNotNull() & value.isNotNull() & ~F.coalesce(F.exists(
        value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)))
    rows = (vectors.filter(usable).select(F.col(id_).cast("long").alias("vec_id"), is_query.alias("asks"),
                                          F.transform(value, lambda x: F.floor(x * float(scale)).cast("long")).alias("vec"))
            .groupBy("vec_id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")))
    rows = write_out(rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}))
    # Of equal vectors the k + 1 smallest ids can matter: k, and one that may be the query's own.
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    items = rows.withColumn("place", rank).filter(F.col("place") <= k + 1).groupBy("h1", "h2").agg(
        F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    items = write_out(items)
    sample = items.select("h1", "h2", "vec").orderBy("h1", "h2").limit(PIVOTS).collect()
    by_width: dict[int, list[list[int]]] = {}
    for row in sample:
        by_width.setdefault(len(row["vec"]), []).append(row["vec"])
    pivots = {w: np.array(v, dtype=float).reshape(len(v), w) for w, v in by_width.items()}
    numbers, at = {}, 0
    for width, block in pivots.items():
        numbers[width] = np.arange(at, at + len(block))
        at += len(block)
    chosen = spark.sparkContext.broadcast(Cells(pivots, numbers))
    items = write_out(items.mapInArrow(_assign(chosen), "h1 long, h2 long, vec array<bigint>, ids array<bigint>, cell long, gap double"))
    shape = items.groupBy("cell").agg(F.max("gap").alias("radius"), F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")).collect()
    table = Cells(pivots, numbers, {r["cell"]: r["radius"] for r in shape}, {r["cell"]: int(r["blocks"]) for r in shape})
    cells = spark.sparkContext.broadcast(table)
    blocks = F.create_map(*[F.lit(v) for pair in table.blocks.items() for v in pair]) if table.blocks else None
    if blocks is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    items = items.withColumn("salt", F.pmod(F.col("h1"), F.element_at(blocks, F.col("cell"))).cast("long"))
    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "vec")
    routed = "query_id long, vec array<bigint>, least double, cell long, salt long"
    near = queries.withColumn("least", F.lit(float("-inf"))).mapInArrow(_route(cells, True), routed)
    floors = (_search_visits(items, near, k).groupBy("query_id")
              .agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k).drop("n"))
    floors = write_out(floors)
    asked = queries.join(floors, "query_id", "left").select(
        "query_id", "vec", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    found = _search_visits(items, asked.mapInArrow(_route(cells, False), routed), k)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
