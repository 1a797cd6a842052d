"""Choosing leaders in order: a row leads when no earlier leader is near it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.config import SimilarityLimits
from fadegraph.operators import vector_blocks as vb
from fadegraph.operators.similarity import nearest
from fadegraph.session import cut_lineage

# Rows decided by one task at a time.
HEAD_ROWS = 4_096
# How much larger each next part of the input is.
_GROWTH = 8


def _lead_in_order(rows: DataFrame, threshold: float) -> DataFrame:
    """Leaders among a bounded number of rows, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept).sort_by("ord").combine_chunks()
        block = vb.Block.read(table)
        leads = np.zeros(len(block), dtype=bool)
        start = 0
        for tile in block.tiles(len(block)):
            near = vb.similarities(tile, block) > threshold
            for row in range(len(tile)):
                at = start + row
                leads[at] = not (near[row, :at] & leads[:at]).any()
            start += len(tile)
        yield from table.filter(pa.array(leads)).to_batches()

    # An exchange of the few rows: without one, the task would read all that they are filtered from.
    return rows.repartition(1).mapInArrow(run, rows.schema)


def _lead_in_rounds(rows: DataFrame, threshold: float, limits: SimilarityLimits) -> DataFrame:
    """Leaders among any number of rows.

    A row with no earlier undecided row near it leads; rows near an earlier
    leader follow.  The first undecided row always leads, so every round
    decides some, and for orders unrelated to the vectors a few rounds do.
    """
    pending, leaders = rows, None
    while not pending.isEmpty():
        blocked = nearest(pending, pending, 1, threshold, earlier=True, limits=limits)
        lead = cut_lineage(pending.join(blocked, pending.id == blocked.l_id, "left_anti"))
        leaders = lead if leaders is None else leaders.unionByName(lead)
        decided = nearest(pending, lead, 1, threshold, earlier=True, limits=limits).select(F.col("l_id").alias("id"))
        decided = decided.unionByName(lead.select("id"))
        pending = cut_lineage(pending.join(decided, "id", "left_anti").select(*rows.columns))
    return rows.limit(0) if leaders is None else leaders


def choose_leaders(points: DataFrame, threshold: float, limits: SimilarityLimits = SimilarityLimits(),
                   head_rows: int = HEAD_ROWS) -> DataFrame:
    """Leaders of ``points`` (a side with unique ord) at a strict threshold.

    Equal to going through the rows one by one.  The rows are taken in growing
    parts of the order.  Leaders of a part first remove their followers from
    all later parts, so a group that holds a large share of the rows is gone
    after the part where its first member turns up, and what is compared with
    itself holds few rows of any one group.
    """
    pending = cut_lineage(points)
    leaders, size = None, head_rows
    while True:
        n_pending = pending.count()
        if n_pending == 0:
            break
        if n_pending <= head_rows:
            head, last = pending, None
        else:
            share = min(1.0, size / n_pending)
            last = pending.agg(F.percentile_approx("ord", share, 100_000).alias("cut")).first()["cut"]
            head = pending.filter(F.col("ord") <= last)
        if last is None or head.limit(2 * head_rows + 1).count() <= 2 * head_rows:
            found = cut_lineage(_lead_in_order(head, threshold))
        else:
            found = cut_lineage(_lead_in_rounds(head, threshold, limits))
        leaders = found if leaders is None else leaders.unionByName(found)
        if last is None:
            break
        later = pending.filter(F.col("ord") > last)
        near = nearest(later, found, 1, threshold, earlier=True, limits=limits).select(F.col("l_id").alias("id"))
        pending = cut_lineage(later.join(near, "id", "left_anti").select(*points.columns))
        size *= _GROWTH
    return points.limit(0) if leaders is None else leaders
