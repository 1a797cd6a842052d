"""New topics from clusters of instances that sit in small topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.config import SimilarityLimits
from fadegraph.functions.vectors import group_mean
from fadegraph.operators.density import dbscan
from fadegraph.operators.identity import fresh_ids
from fadegraph.operators.updates import AsOf
from fadegraph.schema import Snapshot, complete, typed_like
from fadegraph.session import broadcast_if_small, cut_lineage

# Fixed values.
SMALL_TOPIC = 3
DISCOVERY_EPS = 0.3
_NAME_PREFIX = "[INFO] Automatically discovered: "
_NAME_LENGTH = 30


def small_topic_instances(instances: DataFrame, below: int = SMALL_TOPIC) -> DataFrame:
    """Instances of topics with fewer than ``below`` instances.

    The join keeps the small topics, so a large one finds no partner.
    """
    small = instances.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < below)
    return instances.join(small.select("topic_id"), "topic_id", "left_semi")


def discovered_topics(members: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics of clustered instances (id, content, content_embedding, cluster).

    Named after the first member, placed at the mean: (id, topic_name,
    topic_embedding, cluster, n_members).  No id is one of the stored ``topics``.
    """
    means = group_mean(members, ["cluster"], "content_embedding", "topic_embedding")
    heads = members.groupBy("cluster").agg(
        F.min_by("content", "id").alias("content"), F.count(F.lit(1)).alias("n_members"))
    return fresh_ids(heads.join(means, "cluster"), "discovered", ["cluster"], topics.select("id")).select(
        "id", F.concat(F.lit(_NAME_PREFIX), F.substring("content", 1, _NAME_LENGTH)).alias("topic_name"),
        "topic_embedding", "cluster", "n_members")


def discover_topics(snapshot: Snapshot, min_instances: int = 5, as_of: AsOf = None,
                    limits: SimilarityLimits = SimilarityLimits()) -> Snapshot:
    """Cluster the instances of small topics and move each cluster to a topic of its own."""
    instances = snapshot.instances
    if instances.limit(2 * min_instances).count() < 2 * min_instances:
        return snapshot
    loose = cut_lineage(small_topic_instances(instances).select("id", "content", "content_embedding"))
    if loose.limit(min_instances).count() < min_instances:
        return snapshot
    found = dbscan(loose, "id", "content_embedding", DISCOVERY_EPS, min_instances, limits)
    members = cut_lineage(found.filter(F.col("cluster").isNotNull()).select("id", "cluster").join(loose, "id"))
    topics = cut_lineage(discovered_topics(members, snapshot.topics))
    moves = broadcast_if_small(cut_lineage(members.select("id", "cluster").join(
        topics.select("cluster", F.col("id").alias("_new_topic")), "cluster").select(
        F.col("id").alias("_moved"), "_new_topic")))
    joined = instances.join(moves, F.col("id") == F.col("_moved"), "left")
    moved = joined.select(*[
        F.coalesce("_new_topic", "topic_id").alias(c) if c == "topic_id" else F.col(c) for c in instances.columns])
    fresh = complete(topics.drop("cluster", "n_members"), "topics", as_of)
    topics = snapshot.topics.unionByName(fresh.select(*typed_like(snapshot.topics)))
    return snapshot.with_tables(topics=topics, instances=moved)
