"""Merging topics that are too similar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.config import MERGE_PAIRS, MERGE_SIMILARITY, SimilarityLimits
from fadegraph.operators import vector_blocks as vb
from fadegraph.operators.components import forest_roots
from fadegraph.operators.similarity import nearest_lower, similar_pairs
from fadegraph.schema import Snapshot
from fadegraph.session import broadcast_if_small, cut_lineage


def similar_topics(topics: DataFrame, threshold: float = MERGE_SIMILARITY, limit: int = MERGE_PAIRS,
                   limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """The most similar pairs of topics: (rank, id1, id2, similarity)."""
    return similar_pairs(vb.side(topics, "id", "topic_embedding"), threshold, limit, limits)


def merge_targets(pairs: DataFrame, max_pairs: int | None) -> DataFrame:
    """Where each merged topic ends up: (merged_id, kept_id).

    ``pairs`` is (rank, id1, id2).  A topic follows the best-ranked pair that
    names it second; once gone, its later pairs change nothing.  The topic it
    follows may go as well, so the survivor is the root of the chain.
    """
    parents = pairs.groupBy("id2").agg(F.min_by("id1", "rank").alias("parent"))
    roots = forest_roots(parents.select(F.col("id2").alias("node"), "parent"), max_pairs)
    return roots.select(F.col("node").alias("merged_id"), F.col("root").alias("kept_id"))


def merge_plan(topics: DataFrame, threshold: float = MERGE_SIMILARITY, max_pairs: int | None = MERGE_PAIRS,
               limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """(merged_id, kept_id) for the ``max_pairs`` best pairs, or for all of them."""
    if max_pairs is not None:
        return merge_targets(similar_topics(topics, threshold, max_pairs, limits), max_pairs)
    best = nearest_lower(vb.side(topics, "id", "topic_embedding"), threshold, limits)
    return merge_targets(best.select(F.lit(1).alias("rank"), "id1", "id2"), None)


def apply_merge(snapshot: Snapshot, targets: DataFrame, drop_self_loops: bool = False) -> Snapshot:
    """Move instances and edges of merged topics to the kept ones.

    Edges that fall together keep the larger weight and later activation and
    add up their activations.  Only edges at a merged or kept topic are
    grouped; all others pass through.
    """
    targets = cut_lineage(targets)
    pairs = broadcast_if_small(targets)
    moved = snapshot.instances.join(pairs, F.col("topic_id") == F.col("merged_id"), "left")
    instances = moved.select(*[
        F.coalesce("kept_id", "topic_id").alias(c) if c == "topic_id" else F.col(c)
        for c in snapshot.instances.columns])

    to_moves = pairs.select(F.col("merged_id").alias("_to"), F.col("kept_id").alias("_to_kept"))
    from_moves = pairs.select(F.col("merged_id").alias("_from"), F.col("kept_id").alias("_from_kept"))
    involved = targets.select(F.explode(F.array("merged_id", "kept_id")).alias("_at"), F.lit(True).alias("_hit"))
    involved = broadcast_if_small(cut_lineage(involved.distinct()))
    columns = snapshot.edges.columns
    marked = (
        snapshot.edges.join(to_moves, F.col("to_topic") == F.col("_to"), "left")
        .join(from_moves, F.col("from_topic") == F.col("_from"), "left")
        .join(involved.select(F.col("_at").alias("_at1"), F.col("_hit").alias("_hit1")),
              F.col("to_topic") == F.col("_at1"), "left")
        .join(involved.select(F.col("_at").alias("_at2"), F.col("_hit").alias("_hit2")),
              F.col("from_topic") == F.col("_at2"), "left")
        .withColumn("_touched", F.coalesce("_hit1", "_hit2").isNotNull())
        .withColumn("to_topic", F.coalesce("_to_kept", "to_topic"))
        .withColumn("from_topic", F.coalesce("_from_kept", "from_topic"))
    )
    calm = marked.filter(~F.col("_touched")).select(*columns)
    folded = {"weight": F.max("weight"), "last_activated": F.max("last_activated"),
              "activation_count": F.sum("activation_count").cast("int")}
    others = [c for c in columns if c not in {*folded, "from_topic", "to_topic"}]
    rank = F.struct(-F.col("weight"), *[F.col(c) for c in others])
    touched = marked.filter("_touched").groupBy("from_topic", "to_topic").agg(
        *[folded[c].alias(c) for c in columns if c in folded],
        *[F.min_by(c, rank).alias(c) for c in others])
    edges = calm.unionByName(touched.select(*columns))
    if drop_self_loops:
        edges = edges.filter(F.col("from_topic") != F.col("to_topic"))
    topics = snapshot.topics.join(pairs, F.col("id") == F.col("merged_id"), "left_anti")
    return snapshot.with_tables(topics=topics, instances=instances, edges=edges)


def merge_similar(snapshot: Snapshot, threshold: float = MERGE_SIMILARITY, max_pairs: int | None = MERGE_PAIRS,
                  drop_self_loops: bool = False, limits: SimilarityLimits = SimilarityLimits()) -> Snapshot:
    targets = merge_plan(snapshot.topics, threshold, max_pairs, limits)
    return apply_merge(snapshot, targets, drop_self_loops)
