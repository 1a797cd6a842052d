"""Density clustering that is kept up to date: a run works out what added, moved and removed rows can reach.

The state holds for each row how many rows are near it, whether it is a core,
and its cluster.  Changed rows change counts near them only; a cluster can
change only if one of its cores is near a changed row or near one that became
or ceased to be a core; and a border row only if it is near such a row or a core
of such a cluster.  All else keeps its label.  The result is that of
``density.dbscan`` over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.config import SimilarityLimits
from fadegraph.operators import vector_blocks as vb
from fadegraph.operators.components import connected_components
from fadegraph.operators.density import _COUNT, _LINK, _count_neighbours, _spanning_links
from fadegraph.session import cut_lineage

STATE = "id string, vec array<double>, n_near double, is_core boolean, cluster string"
_ID, _LABEL = "id string", "id string, label string"


def _any_near(eps: float):
    def kernel(left: vb.Block, right: vb.Block) -> pa.RecordBatch:
        return vb.result_batch(_ID, left.id[(1.0 - vb.similarities(left, right) <= eps).any(axis=1)])

    return kernel


def _lowest_near(eps: float):
    """The lowest name, which blocks have as ``id`` and in order, among the near rows of the right."""

    def kernel(left: vb.Block, right: vb.Block) -> pa.RecordBatch:
        near = 1.0 - vb.similarities(left, right) <= eps
        hit = near.any(axis=1)
        return vb.result_batch(_LABEL, left.id[hit], right.id[near[hit].argmax(axis=1)])

    return kernel


def _side(rows: DataFrame, value: str | None = None, id_: str = "id") -> DataFrame:
    return rows.select(F.col(id_).alias("id"), F.lit(0).cast("long").alias("ord"),
                       (F.col(value) if value else F.lit(0.0)).cast("double").alias("value"), "vec")


def update_clusters(state: DataFrame | None, added: DataFrame, removed: DataFrame | None = None, id_: str = "id", vector: str = "vec",
                    eps: float = 0.3, min_samples: int = 5, limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """The state after rows were added and those of the ids in ``removed`` (id) were taken away.

    A moved row is removed and added again.  Without a state all rows are new.
    The state is (id, vec, n_near, is_core, cluster), cluster null for noise;
    rows whose vectors have no length are not in it.  Ids are unique.
    """
    reach = 1.0 - eps
    fresh = cut_lineage(vb.side(added, id_, vector).select("id", "vec"))
    old = fresh.sparkSession.createDataFrame([], STATE) if state is None else state
    ids = fresh.select("id").limit(0) if removed is None else cut_lineage(removed.select("id"))
    gone, kept = cut_lineage(old.join(ids, "id", "left_semi")), old.join(ids, "id", "left_anti")
    after = cut_lineage(kept.select("id", "vec").unionByName(fresh))

    # Equal vectors are one spot, which counts as often as it is there.
    changed = cut_lineage(gone.select("vec", F.lit(-1.0).alias("sign")).unionByName(fresh.select("vec", F.lit(1.0).alias("sign")))
                          .groupBy("vec").agg(F.sum("sign").alias("sign")).withColumn("id", F.sha2(F.to_json("vec"), 256)))
    known = kept.groupBy("vec").agg(F.first("n_near").alias("n_old"), F.first("is_core").alias("core_old"), F.min("cluster").alias("cluster_old"))
    spots = cut_lineage(after.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).join(known, "vec", "left"))
    seen = spots.filter("n_old is not null")
    shift = vb.compare(_side(seen), _side(changed, "sign"), _count_neighbours(eps), _COUNT, reach, limits).groupBy("id").agg(F.sum("weight").alias("shift"))
    whole = vb.compare(_side(spots.filter("n_old is null")), _side(spots, "copies"), _count_neighbours(eps), _COUNT, reach, limits).groupBy("id").agg(
        F.sum("weight").alias("whole"))
    n_near = F.coalesce(F.col("n_old") + F.coalesce("shift", F.lit(0.0)), "whole", F.lit(0.0))
    counted = cut_lineage(spots.join(shift, "id", "left").join(whole, "id", "left").withColumn("n_near", n_near).drop("shift", "whole", "n_old")
                          .withColumn("core", F.col("n_near") >= min_samples))

    # Clusters with a core near a changed row, or near one that became or ceased to be a core.
    flipped = counted.filter("core_old is not null and core_old <> core").select("id", "vec")
    touch = cut_lineage(changed.select("id", "vec").unionByName(flipped))
    at_touch = cut_lineage(vb.compare(_side(counted), _side(touch), _any_near(eps), _ID, reach, limits).distinct().withColumn("touched", F.lit(True)))
    marked = cut_lineage(counted.join(at_touch, "id", "left").withColumn("touched", F.coalesce("touched", F.lit(False))))
    stirred = cut_lineage(marked.filter("touched and core_old").select(F.col("cluster_old").alias("stirred")).unionByName(
        gone.filter("is_core").select(F.col("cluster").alias("stirred"))).distinct())
    marked = cut_lineage(marked.join(stirred, F.col("cluster_old") == F.col("stirred"), "left"))
    anew = cut_lineage(marked.filter("core and (touched or stirred is not null)").withColumn("value", F.lit(1.0)))
    links = vb.compare(_side(anew, "value"), _side(anew, "value"), _spanning_links(eps), _LINK, reach, limits).filter("is_core = 1")
    named = cut_lineage(connected_components(links.select("a", "b").distinct()).select(F.col("node").alias("id"), "component"))
    cores = cut_lineage(marked.filter("core").join(named, "id", "left").select("id", "vec", F.coalesce("component", "cluster_old").alias("name")))

    # Border rows near any of that go to the lowest-named cluster they touch.
    rest = marked.filter("not core")
    beside = vb.compare(_side(rest), _side(anew), _any_near(eps), _ID, reach, limits).unionByName(rest.filter("touched").select("id")).distinct()
    open_ = cut_lineage(rest.join(beside, "id", "left_semi"))
    border = vb.compare(_side(open_), _side(cores, id_="name"), _lowest_near(eps), _LABEL, reach, limits).groupBy("id").agg(F.min("label").alias("label"))
    label = (F.when(F.col("core"), F.col("name")).when(F.col("is_open"), F.col("label")).otherwise(F.col("cluster_old")))
    settled = (marked.join(cores.select("id", "name"), "id", "left").join(open_.select("id", F.lit(True).alias("is_open")), "id", "left")
               .join(border, "id", "left").select("vec", "n_near", F.col("core").alias("is_core"), label.alias("cluster")))
    return cut_lineage(after.join(settled, "vec").select("id", "vec", "n_near", "is_core", "cluster"))
