"""Nearest vectors and most similar pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fadegraph.config import MERGE_PAIRS, SimilarityLimits
from fadegraph.operators import vector_blocks as vb
from fadegraph.session import broadcast_if_small, cut_lineage

_MATCH = "l_id string, r_id string, r_ord long, similarity double"
_RANKED = _MATCH + ", rank long"
_PAIR = "id1 string, id2 string, similarity double"


def _top_of_block(left: vb.Block, right: vb.Block, k: int, floor: float | None, earlier: bool,
                  at_least: np.ndarray | None = None) -> list[np.ndarray]:
    """Row, column, similarity and rank of the k best columns of every row.

    ``right`` is ordered by (ord, id), and the first of equals is the one to keep.  ``floor``
    is a strict bound for all rows; of columns below a row's ``at_least`` none is wanted.
    """
    bar = np.full(len(left), -np.inf if floor is None else floor)
    if at_least is not None:
        bar = np.maximum(bar, at_least)
    best, place = np.full((len(left), k), -np.inf), np.full((len(left), k), len(right))
    for rows, cols, sims in vb.screened(left, right, bar, k, earlier):
        wanted = sims >= bar[rows] if floor is None else (sims >= bar[rows]) & (sims > floor)
        rows, cols, sims = rows[wanted], cols[wanted], sims[wanted]
        hit = np.unique(rows)
        if not len(hit):
            continue
        # The rows' winners so far come first among equals: their columns are lower.
        row = np.concatenate([np.repeat(hit, k), rows])
        col, sim = np.concatenate([place[hit].ravel(), cols]), np.concatenate([best[hit].ravel(), sims])
        order = np.lexsort((col, -sim, row))
        at = np.arange(len(order)) - np.searchsorted(row[order], row[order], side="left")
        order, at = order[at < k], at[at < k]
        best[row[order], at], place[row[order], at] = sim[order], col[order]
        bar[hit] = np.maximum(bar[hit], best[hit, -1])
    rows, ranks = np.nonzero(np.isfinite(best))
    return [rows, place[rows, ranks], best[rows, ranks], ranks + 1]


def _match_batch(left: vb.Block, right: vb.Block, picked: list[np.ndarray]) -> pa.RecordBatch:
    rows, cols, sims, _ = picked
    return vb.result_batch(_MATCH, left.id[rows], right.id[cols], right.ord[cols], sims)


def _best_per_left(matches: DataFrame, k: int) -> DataFrame:
    """Merge the block winners; Spark drops losers before the shuffle as well."""
    order = Window.partitionBy("l_id").orderBy(F.desc("similarity"), "r_ord", "r_id")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _stream_base(base: DataFrame, queries: vb.Block, k: int, floor: float | None, earlier: bool) -> DataFrame:
    """Broadcast queries, one pass over the base.

    Each task keeps the best k per query of all its batches, so it emits at
    most k rows per query however long the partition is.
    """
    shared = base.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        names = np.empty((0,), dtype=object)
        kept = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0), names]
        for batch in batches:
            if not batch.num_rows or not len(asked):
                continue
            block = vb.Block.read(batch)
            rows, cols, sims, _ = _top_of_block(asked, block, k, floor, earlier)
            found = [rows, block.ord[cols], sims, block.id[cols]]
            kept = [np.concatenate(pair) for pair in zip(kept, found, strict=True)]
            order = np.lexsort((kept[3].astype(str), kept[1], -kept[2], kept[0]))
            owner = kept[0][order]
            first = np.searchsorted(owner, owner, side="left")
            order = order[np.arange(len(order)) - first < k]
            kept = [part[order] for part in kept]
        if len(kept[0]):
            yield vb.result_batch(_MATCH, asked.id[kept[0]], kept[3], kept[1], kept[2])

    return base.mapInArrow(run, _MATCH)


def nearest(left: DataFrame, right: DataFrame, k: int, min_similarity: float | None = None, earlier: bool = False,
            limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """The k rows of ``right`` most similar to each row of ``left``, exactly.

    Both sides come from ``vector_blocks.side``.  Ties go to the lower
    (ord, id).  ``min_similarity`` is a strict bound; ``earlier`` admits only
    rows of ``right`` with a smaller ord.
    Result: (l_id, r_id, r_ord, similarity, rank).
    """

    @vb.whole_blocks
    def kernel(a: vb.Block, b: vb.Block) -> pa.RecordBatch:
        return _match_batch(a, b, _top_of_block(a, b, k, min_similarity, earlier))

    @vb.whole_blocks
    def beyond(a: vb.Block, b: vb.Block) -> pa.RecordBatch:
        return _match_batch(a, b, _top_of_block(a, b, k, min_similarity, earlier, a.value))

    @vb.whole_blocks
    def ranked(a: vb.Block, b: vb.Block) -> pa.RecordBatch:
        rows, cols, sims, ranks = _top_of_block(a, b, k, min_similarity, earlier)
        return vb.result_batch(_RANKED, a.id[rows], b.id[cols], b.ord[cols], sims, ranks)

    base = vb.fetch_if_small(right, limits)
    if base is not None:
        # Each row met the whole base at once: nothing is left to merge.
        found = vb.against_broadcast(left, base, ranked, _RANKED)
        return found.withColumn("rank", F.col("rank").cast("int"))
    queries = vb.fetch_if_small(left, limits)
    if queries is not None:
        return _best_per_left(_stream_base(right, queries, k, min_similarity, earlier), k)
    placed, cells = vb.partition_base(cut_lineage(vb.thin_copies(right, k)), limits)
    # The k-th best row of a query's own cell bounds how far it has to look.
    home = vb.visit_cells(left, cells, None)
    first = _best_per_left(vb.against_cells(home, placed, cells, kernel, _MATCH, limits), k)
    widest = vb.radius_of(-1.0 if min_similarity is None else min_similarity)
    reach = cut_lineage(first.groupBy("l_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("own_least")))
    own_reach = F.when(F.col("own_least").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("own_least"))))
    # What is below the k-th best row found so far is not wanted; the last digits may differ from block to block.
    least = F.coalesce(F.col("own_least") - 1e-11, F.lit(-2.0))
    looking = left.join(broadcast_if_small(reach), left.id == reach.l_id, "left").select(
        *[least.alias(c) if c == "value" else F.col(c) for c in left.columns],
        F.least(F.coalesce(own_reach, F.lit(widest)), F.lit(widest)).alias("reach"))
    visits = cut_lineage(vb.visit_cells(looking, cells, F.col("reach")))
    return _best_per_left(vb.against_cells(visits, placed, cells, beyond, _MATCH, limits), k)


def _in_order(rows: np.ndarray, cols: np.ndarray, sims: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order of pairs: the most similar first, ties by the lower and then the higher name."""
    return np.lexsort((np.maximum(first[rows], second[cols]), np.minimum(first[rows], second[cols]), -sims))


def best_pairs_kernel(min_similarity: float, limit: int, either: bool = False) -> vb.Kernel:
    """The best ``limit`` pairs (id1 < id2) of two blocks above a strict bound.

    The first block gives id1; with ``either`` each block may, so two blocks without
    a row in common need to be compared only one way round.
    """

    @vb.whole_blocks
    def kernel(a: vb.Block, b: vb.Block) -> pa.RecordBatch:
        first, second = vb.name_places(a, b)
        bar = np.full(len(a), float(min_similarity))
        kept = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]
        for rows, cols, sims in vb.screened(a, b, bar):
            apart = first[rows] != second[cols] if either else first[rows] < second[cols]
            good = apart & (sims > min_similarity) & (sims >= bar[rows])
            if not good.any():
                continue
            kept = [np.concatenate([old, new[good]]) for old, new in zip(kept, (rows, cols, sims), strict=True)]
            if len(kept[0]) <= limit:
                continue
            cut = np.partition(kept[2], len(kept[2]) - limit)[len(kept[2]) - limit]
            kept = [part[kept[2] >= cut] for part in kept]
            kept = [part[_in_order(*kept, first, second)[:limit]] for part in kept]
            bar[:] = np.maximum(bar, cut)
        rows, cols, sims = kept
        order = _in_order(*kept, first, second)
        rows, cols, sims = rows[order], cols[order], sims[order]
        turned = first[rows] > second[cols]
        left, right = a.id[rows], b.id[cols]
        return vb.result_batch(_PAIR, np.where(turned, right, left), np.where(turned, left, right), sims)

    return kernel


def similar_pairs(rows: DataFrame, min_similarity: float, limit: int = MERGE_PAIRS,
                  limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """The ``limit`` most similar pairs above a strict bound: (rank, id1, id2, similarity).

    id1 < id2; ties go to the lower ids.  Each block hands on its own best
    ``limit`` pairs, so the last sort sees that many rows per block.
    """

    kernel = best_pairs_kernel(min_similarity, limit)
    base = vb.fetch_if_small(rows, limits)
    if base is not None:
        pairs = vb.against_broadcast(rows, base, kernel, _PAIR)
    else:
        # The best pairs of two groups of copies use their lowest ids.
        distinct = cut_lineage(vb.thin_copies(rows, limit + 1))
        pairs = vb.compare_within(distinct, kernel, _PAIR, min_similarity, limits, best_pairs_kernel(min_similarity, limit, True))
    best = pairs.orderBy(F.desc("similarity"), "id1", "id2").limit(limit)
    order = Window.orderBy(F.desc("similarity"), "id1", "id2")
    return best.select(F.row_number().over(order).alias("rank"), "id1", "id2", "similarity")


def follower_kernel(min_similarity: float, both: bool = False) -> vb.Kernel:
    """Rows of the first block, or of ``both``, with their best row of lower name in the other, above a strict bound."""

    @vb.whole_blocks
    def kernel(a: vb.Block, b: vb.Block) -> pa.RecordBatch:
        first, second = vb.name_places(a, b)
        ids = np.empty(1 + max(first.max(), second.max()), dtype=object)
        ids[first], ids[second] = a.id, b.id
        bar = np.full(len(a), float(min_similarity))
        # By place: the best similarity so far and the lowest row that has it.
        best, lower = np.full(len(ids), -np.inf), np.full(len(ids), len(ids))
        for rows, cols, sims in vb.screened(a, b, bar):
            one, two = first[rows], second[cols]
            good = (sims > min_similarity) & ((one != two) if both else (two < one))
            low, high, sims = np.minimum(one, two)[good], np.maximum(one, two)[good], sims[good]
            before = best[high]
            np.maximum.at(best, high, sims)
            lower[high[best[high] > before]] = len(ids)
            won = sims == best[high]
            np.minimum.at(lower, high[won], low[won])
            if not both:
                bar[rows] = np.maximum(bar[rows], best[one])
        found = np.flatnonzero(lower < len(ids))
        return vb.result_batch(_PAIR, ids[lower[found]], ids[found], best[found])

    return kernel


def nearest_lower(rows: DataFrame, min_similarity: float,
                  limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """For each row its most similar row of lower id, above a strict bound.

    This is what an unlimited list of pairs comes down to when each row
    follows its best partner: (id1, id2, similarity), one row per id2.
    """

    groups = rows.groupBy("vec").agg(F.min("id").alias("first"))
    firsts = cut_lineage(groups.select(F.col("first").alias("id"), F.lit(0).cast("long").alias("ord"),
                                       F.lit(0.0).alias("value"), "vec"))
    pairs = vb.compare_within(
        firsts, follower_kernel(min_similarity), _PAIR, min_similarity, limits, follower_kernel(min_similarity, True))
    best = pairs.groupBy("id2").agg(
        F.min_by(F.struct("id1", "similarity"), F.struct(-F.col("similarity"), F.col("id1"))).alias("best"))
    # A later copy follows the first one, unless that has an equal before it.
    copies = rows.join(firsts.select(F.col("id").alias("first"), "vec"), "vec")
    joined = copies.join(best, F.col("first") == F.col("id2"), "left")
    is_first = F.col("id") == F.col("first")
    follows = ~is_first & ~F.coalesce(F.col("best.similarity") >= 1.0, F.lit(False))
    return joined.select(
        F.when(follows, F.col("first")).otherwise(F.col("best.id1")).alias("id1"),
        F.col("id").alias("id2"),
        F.when(follows, F.lit(1.0)).otherwise(F.col("best.similarity")).alias("similarity"),
    ).filter(F.col("id1").isNotNull() & (F.col("similarity") > min_similarity))
