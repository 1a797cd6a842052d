"""Nearest vectors from a stored cell layout, and similar pairs by random hyperplanes.

Both compare exactly what they bring together; what they do not bring together
is lost, and how much that is is measured and returned.  The exact ways
(operators.similarity) stay the default everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fadegraph.config import MERGE_PAIRS, SimilarityLimits
from fadegraph.operators import vector_blocks as vb
from fadegraph.operators.similarity import _MATCH, _PAIR, _best_per_left, _match_batch, _top_of_block, best_pairs_kernel, nearest
from fadegraph.session import broadcast_if_small, cut_lineage

# Rows, picked by a hash of their id, that the centres are fitted on.
FIT_ROWS = 20_000
# Queries, picked likewise, whose exact neighbours tell how many cells have to be visited.
MEASURED = 256
_SEED = 71


@dataclass(frozen=True)
class StoredCells:
    """Vectors in folders by cell: ``path/rows/cell=N``, and the cells' centres, sizes and reaches."""

    spark: SparkSession
    path: str
    cells: vb.Cells

    def rows(self, visited: list[int] | None = None) -> DataFrame:
        """Rows of all cells, or of some; the others' files are not opened."""
        stored = self.spark.read.parquet(f"{self.path}/rows")
        return stored if visited is None else stored.filter(F.col("cell").isin(visited))


def store_cells(base: DataFrame, path: str, cells: int | None = None, limits: SimilarityLimits = SimilarityLimits()) -> StoredCells:
    """Write rows of ``vector_blocks.side`` by cell, around centres fitted once on at most ``FIT_ROWS`` rows."""
    base = cut_lineage(base)
    count = base.count()
    if not count:
        raise ValueError("there are no vectors to lay out in cells")
    wanted = max(2, min(limits.max_cells, cells or math.ceil(math.sqrt(count))))
    sample = base.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select(array_to_vector("vec").alias("features"))
    centres = np.array(KMeans(k=wanted, distanceMeasure="cosine", seed=_SEED, maxIter=10).fit(sample).clusterCenters())
    lengths = np.sqrt((centres * centres).sum(axis=1))
    centres = centres[lengths > 1e-9] / lengths[lengths > 1e-9][:, None]
    placed, made = vb.assign_cells(base, centres)
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    table = [(i, int(n), float(r), c.tolist()) for i, (n, r, c) in enumerate(zip(made.counts, made.reach, centres))]
    base.sparkSession.createDataFrame(table, "cell int, n long, reach double, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
    return StoredCells(base.sparkSession, path, made)


def load_cells(spark: SparkSession, path: str) -> StoredCells:
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return StoredCells(spark, path, vb.Cells(
        np.array([r["centre"] for r in table]), np.array([r["n"] for r in table]), np.array([r["reach"] for r in table])))


def _probed(left: DataFrame, cells: vb.Cells, probes: int) -> DataFrame:
    """Visitors with the array ``cells`` of the ``probes`` nearest cells that hold rows, nearest first."""
    shared = left.sparkSession.sparkContext.broadcast(cells)
    schema = T.StructType(left.schema.fields + [T.StructField("cells", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = shared.value
        occupied = np.flatnonzero(info.counts > 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = np.asarray(batch.column("vec").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            closeness = matrix @ info.pivots[occupied].T
            order = occupied[np.argsort(-closeness, axis=1, kind="stable")[:, :probes]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order), type=pa.list_(pa.int64()))], names=schema.names)

    return left.mapInArrow(run, schema)


def _nearest_cells(left: DataFrame, cells: vb.Cells, probes: int) -> DataFrame:
    """One row for each visitor and each of the ``probes`` nearest cells that hold rows, with ``cell`` and its place."""
    return _probed(left, cells, probes).select(*left.columns, F.posexplode("cells").alias("place", "cell"))


def search_cells(stored: StoredCells, left: DataFrame, k: int, probes: int, limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """The k most similar rows in the ``probes`` nearest cells of each visitor: (l_id, r_id, r_ord, similarity, rank).

    Only cells that some visitor visits are read.
    """

    @vb.whole_blocks
    def kernel(a: vb.Block, b: vb.Block) -> pa.RecordBatch:
        return _match_batch(a, b, _top_of_block(a, b, k, None, False))

    n_cells = len(stored.cells.counts)
    visits = cut_lineage(vb.pack_visits(_probed(left, stored.cells, probes), n_cells))
    visited = vb.cells_visited(visits, n_cells)
    placed = stored.rows(visited).withColumn("cell", F.col("cell").cast("long"))
    return _best_per_left(vb.against_cells(visits, placed, stored.cells, kernel, _MATCH, limits), k)


def probes_for(stored: StoredCells, left: DataFrame, k: int, recall: float = 0.95,
               limits: SimilarityLimits = SimilarityLimits()) -> tuple[int, float]:
    """Cells to visit so that ``recall`` of the exact k neighbours of a sample of visitors are found, and the recall measured."""
    sample = cut_lineage(left.orderBy(F.xxhash64("id"), "id").limit(MEASURED))
    rows = stored.rows()
    exact = nearest(sample, rows.select(*left.columns), k, limits=limits).select("l_id", F.col("r_id").alias("id"))
    homes = exact.join(rows.select("id", F.col("cell").cast("long").alias("cell")), "id")
    places = _nearest_cells(sample, stored.cells, len(stored.cells.counts)).select(F.col("id").alias("l_id"), "cell", "place")
    found = np.sort([r[0] for r in homes.join(places, ["l_id", "cell"]).select("place").collect()])  # MEASURED * k at most
    if not len(found):
        return 1, 1.0
    probes = int(found[min(len(found) - 1, math.ceil(recall * len(found)) - 1)]) + 1
    return probes, float((found < probes).mean())


def nearest_in_cells(stored: StoredCells, left: DataFrame, k: int, recall: float = 0.95,
                     limits: SimilarityLimits = SimilarityLimits()) -> tuple[DataFrame, float]:
    """Approximate ``similarity.nearest``: matches, and the share of exact neighbours that it finds, measured on a sample."""
    probes, measured = probes_for(stored, left, k, recall, limits)
    return search_cells(stored, left, k, probes, limits), measured


def hash_plan(count: int, min_similarity: float, recall: float, limits: SimilarityLimits) -> tuple[int, int]:
    """Bits of a key so that a bucket of evenly spread rows is a fraction of a block, and tables that ``recall`` takes.

    Two vectors lie on one side of a random hyperplane with probability one
    minus their angle over pi, so that all bits of some table agree is known.
    """
    bits = min(62, max(1, math.ceil(math.log2(max(2.0, 4.0 * count / limits.block_rows)))))
    agree = (1.0 - math.acos(max(-1.0, min(1.0, min_similarity))) / math.pi) ** bits
    tables = 1 if agree >= 1.0 else max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - agree)))
    return bits, tables


def _keys(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """Rows with an array ``keys``: the side of each of ``bits`` random hyperplanes, by table."""
    schema = T.StructType(rows.schema.fields + [T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = np.asarray(batch.column("vec").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            planes = np.random.default_rng(_SEED).normal(size=(matrix.shape[1], tables * bits))
            keys = (matrix @ planes > 0).reshape(-1, tables, bits) @ powers
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), type=pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def similar_pairs_hashed(rows: DataFrame, min_similarity: float, limit: int = MERGE_PAIRS, recall: float = 0.95,
                         limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """Approximate ``similarity.similar_pairs``: rows of one bucket in some table are compared exactly.

    A pair at the bound is found with probability ``recall``, a closer one more
    often.  Buckets are cut into blocks, so a hot one is many tasks, and copies
    of a vector beyond those that ``limit`` pairs can use are left out.
    """
    kernel = best_pairs_kernel(min_similarity, limit)
    distinct = cut_lineage(vb.thin_copies(rows, limit + 1))
    bits, tables = hash_plan(distinct.count(), min_similarity, recall, limits)
    keyed = cut_lineage(_keys(distinct, bits, tables))
    places = keyed.select("id", F.posexplode("keys").alias("hash_table", "key"))
    crowds = cut_lineage(places.groupBy("hash_table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "hash_table", "key", F.ceil(F.col("n") / limits.block_rows).alias("blocks")))
    dealt = keyed.select("id", "ord", "value", "vec", F.posexplode("keys").alias("hash_table", "key")).join(
        broadcast_if_small(crowds), ["hash_table", "key"]).withColumn("side", F.pmod(F.xxhash64("id"), "blocks"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns(
        {"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    empty = vb._arrow_schema(_PAIR).empty_table()

    def run(group: pa.Table) -> pa.Table:
        i, sides = group.column("i")[0].as_py(), np.asarray(group.column("side"))
        own, others = (vb.Block.read(group.filter(pa.array(mask))) for mask in (sides == i, sides != i))
        blocks = [(own, own)] if group.column("j")[0].as_py() == i else [(own, others), (others, own)]
        found = [kernel(a, b) for a, b in blocks if len(a) and len(b)]
        return pa.Table.from_batches(found) if found else empty

    pairs = met.select("hash_table", "key", "i", "j", "side", "id", "ord", "value", "vec").groupBy("hash_table", "key", "i", "j").applyInArrow(run, _PAIR)
    best = pairs.groupBy("id1", "id2").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "id1", "id2").limit(limit)
    order = Window.orderBy(F.desc("similarity"), "id1", "id2")  # of ``limit`` rows
    return best.select(F.row_number().over(order).alias("rank"), "id1", "id2", "similarity")


def share_found(exact: DataFrame, found: DataFrame, keys: list[str]) -> float:
    """The recall of ``found``: the share of the exact rows that it holds; 1 if there are none."""
    both = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("_hit")), keys, "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hits")).first()
    return both["hits"] / both["n"] if both["n"] else 1.0
