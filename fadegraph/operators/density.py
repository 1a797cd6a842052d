"""Density clustering (DBSCAN) by cosine distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.config import SimilarityLimits
from fadegraph.operators import vector_blocks as vb
from fadegraph.operators.components import connected_components
from fadegraph.session import cut_lineage

_COUNT = "id string, weight double"
_LINK = "a string, b string, is_core long"


def _count_neighbours(eps: float):
    def kernel(left: vb.Block, right: vb.Block) -> pa.RecordBatch:
        near = 1.0 - vb.similarities(left, right) <= eps
        return vb.result_batch(_COUNT, left.id, near @ right.value)

    return kernel


def _spanning_links(eps: float):
    """Links that connect what the block connects, without its pairs.

    Core rows that hang together inside the block all point to one of them,
    and any other row points once to each such set it touches.
    """

    def kernel(left: vb.Block, right: vb.Block) -> pa.RecordBatch:
        near = 1.0 - vb.similarities(left, right) <= eps
        core = left.value > 0
        far = len(right)
        name = np.arange(len(right))
        joined = near[core]
        while joined.size:
            seen = np.where(joined, name[None, :], far).min(axis=1)
            heard = np.where(joined, seen[:, None], far).min(axis=0)
            lower = np.minimum(name, heard)
            lower = lower[lower]
            if (lower == name).all():
                break
            name = lower
        lowest = np.where(near, name[None, :], far).min(axis=1)
        hit = core & (lowest < far)
        starts = [left.id[hit], right.id[name != np.arange(far)]]
        ends = [right.id[lowest[hit]], right.id[name[name != np.arange(far)]]]
        rows, cols = np.nonzero(near & ~core[:, None])
        edge = np.unique(np.stack([rows, name[cols]], axis=1), axis=0) if len(rows) else np.zeros((0, 2), int)
        marks = np.concatenate([np.ones(sum(map(len, starts)), int), np.zeros(len(edge), int)])
        return vb.result_batch(
            _LINK, np.concatenate([*starts, left.id[edge[:, 0]]]),
            np.concatenate([*ends, right.id[edge[:, 1]]]), marks)

    return kernel


def dbscan(rows: DataFrame, id_: str, vector: str, eps: float = 0.3, min_samples: int = 5,
           limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """Clusters of ``rows``: (id, is_core, cluster), cluster null for noise.

    A cluster is named by its lowest core id, and a border row goes to the
    lowest-named cluster it touches.  Rows with equal vectors are compared once,
    weighted by their number, so a group of copies costs one row.
    """
    points = vb.side(rows, id_, vector)
    distinct = cut_lineage(points.groupBy("vec").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("value"))
        .select("id", F.lit(0).cast("long").alias("ord"), "value", "vec"))
    reach = 1.0 - eps
    counts = vb.compare(distinct, distinct, _count_neighbours(eps), _COUNT, reach, limits)
    total = counts.groupBy("id").agg((F.sum("weight") >= min_samples).cast("double").alias("core"))
    marked = cut_lineage(distinct.join(total, "id", "left").select(
        "id", "ord", F.coalesce("core", F.lit(0.0)).alias("value"), "vec"))
    cores = marked.filter(F.col("value") > 0)
    links = cut_lineage(vb.compare(marked, cores, _spanning_links(eps), _LINK, reach, limits).distinct())
    named = connected_components(links.filter("is_core = 1"))
    border = links.filter("is_core = 0").join(named, F.col("b") == named.node).groupBy("a").agg(
        F.min("component").alias("component"))
    cluster = named.select(F.col("node").alias("first"), "component", F.lit(True).alias("is_core")).unionByName(
        border.select(F.col("a").alias("first"), "component", F.lit(False).alias("is_core")))
    copies = points.select("id", "vec").join(marked.select(F.col("id").alias("first"), "vec"), "vec")
    found = copies.join(cluster, "first", "left").select("id", "is_core", F.col("component").alias("cluster"))
    every = rows.select(F.col(id_).cast("string").alias("id"))
    return every.join(found, "id", "left").select(
        "id", F.coalesce("is_core", F.lit(False)).alias("is_core"), "cluster")
