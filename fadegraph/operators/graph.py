"""Neighbours, orphans, statistics and export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fadegraph.config import EDGE_FANOUT, SearchConfig
from fadegraph.functions import scoring
from fadegraph.schema import Snapshot


def neighbors(edges: DataFrame, topics: DataFrame, topic_ids: DataFrame | None = None,
              min_weight: float = 0.3) -> DataFrame:
    """Topics that edges of at least ``min_weight`` lead to, heaviest first.

    For the topics of ``topic_ids`` (topic_id), or all of them:
    (topic_id, neighbor_id, neighbor_name, edge_weight).
    """
    kept = edges.filter(F.col("weight") >= min_weight)
    if topic_ids is not None:
        kept = kept.join(topic_ids.select("topic_id"), F.col("from_topic") == F.col("topic_id"), "left_semi")
    names = topics.select(F.col("id").alias("neighbor_id"), F.col("topic_name").alias("neighbor_name"))
    return kept.join(names, F.col("to_topic") == F.col("neighbor_id")).select(
        F.col("from_topic").alias("topic_id"), "neighbor_id", "neighbor_name", F.col("weight").alias("edge_weight"),
    ).orderBy("topic_id", F.desc("edge_weight"), "neighbor_id")


def unlinked(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """Topics at neither end of an edge."""
    ends = edges.select(F.col("from_topic").alias("_end")).unionByName(edges.select(F.col("to_topic").alias("_end")))
    return topics.join(ends, topics.id == F.col("_end"), "left_anti")


def orphans(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """Unlinked topics of strength below 0.3, weakest first."""
    weak = topics.filter(F.col("strength") < 0.3)
    return unlinked(weak, edges).select("id", "topic_name", "strength").orderBy("strength", "id")


def forgotten_orphans(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """Unlinked topics that maintenance removes."""
    return unlinked(topics.filter((F.col("strength") < 0.1) & (F.col("access_count") < 2)), edges)


def ranked_edges(edges: DataFrame, config: SearchConfig) -> DataFrame:
    """Edges a search may follow: the 8 heaviest per topic, before dropout.

    (from_topic, to_topic, weight, edge_rank, is_dropped)
    """
    order = Window.partitionBy("from_topic").orderBy(F.desc("weight"), "to_topic")
    top = (
        edges.filter(F.col("weight") >= config.min_edge_weight)
        .select("from_topic", "to_topic", "weight", F.row_number().over(order).alias("edge_rank"))
        .filter(F.col("edge_rank") <= EDGE_FANOUT)
    )
    draw = scoring.dropout_draw(F.col("from_topic"), F.col("to_topic"), config.dropout_seed)
    return top.withColumn("is_dropped", scoring.is_dropped(F.col("weight"), draw, config.dropout_rate))


def instance_counts(instances: DataFrame) -> DataFrame:
    return instances.groupBy("topic_id").agg(F.count(F.lit(1)).alias("instance_count"))


def export_nodes(topics: DataFrame, instances: DataFrame) -> DataFrame:
    counts = instance_counts(instances)
    return topics.join(counts, topics.id == counts.topic_id, "left").select(
        "id", F.col("topic_name").alias("label"), "strength", "access_count",
        F.coalesce("instance_count", F.lit(0)).cast("long").alias("instance_count"),
        scoring.node_size(F.col("strength"), F.col("access_count")).alias("size"),
    )


def export_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("weight") > 0.2).select(
        F.col("from_topic").alias("source"), F.col("to_topic").alias("target"), "weight", "activation_count")


def _one_row(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Bring one-row tables with different columns into one row."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(n).alias(n) for n in names])


def stats(snapshot: Snapshot) -> DataFrame:
    """One row of counts and averages over the three tables."""
    n = F.count(F.lit(1))
    parts = [
        snapshot.topics.agg(
            n.alias("total_topics"), F.avg("strength").alias("avg_topic_strength"),
            F.count_if(F.col("strength") > 0.5).alias("strong_topics"),
            F.count_if(F.col("strength") < 0.2).alias("weak_topics")),
        snapshot.instances.agg(n.alias("total_instances")),
        snapshot.edges.agg(n.alias("total_edges"), F.avg("weight").alias("avg_edge_weight")),
    ]
    return _one_row(parts, ["total_topics", "total_instances", "total_edges", "avg_topic_strength",
                            "avg_edge_weight", "strong_topics", "weak_topics"])


def export_stats(snapshot: Snapshot) -> DataFrame:
    """Totals of the export; edges count as exported, an absent average is 0."""
    n = F.count(F.lit(1))
    parts = [
        snapshot.topics.agg(
            F.countDistinct("id").alias("total_topics"),
            F.coalesce(F.avg("strength"), F.lit(0.0)).alias("avg_topic_strength")),
        snapshot.instances.agg(n.alias("total_instances")),
        export_edges(snapshot.edges).agg(n.alias("total_edges")),
    ]
    return _one_row(parts, ["total_topics", "total_instances", "total_edges", "avg_topic_strength"])
