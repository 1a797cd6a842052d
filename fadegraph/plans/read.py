"""Reading the memory, with and without its effects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fadegraph.config import EDGE_REINFORCEMENT, TOP_TOPICS, SearchConfig, SimilarityLimits
from fadegraph.operators.search import search, top_instances, top_topics
from fadegraph.operators.updates import AsOf, reinforce_edges, reinforce_topics
from fadegraph.schema import Snapshot, clock
from fadegraph.session import broadcast_if_small, cut_lineage
from fadegraph.sources.tables import Changes, Version


@dataclass(frozen=True)
class Recall:
    """Answers and what was visited; the effects are worked out when asked for.

    ``touched`` is (topic_id, n_visits, n_returns), ``traversed`` (from_topic,
    to_topic, n_traversals).
    """

    results: DataFrame
    visited: DataFrame
    effects: Callable[[], Snapshot]
    touched: DataFrame
    traversed: DataFrame
    boost: float
    now: Column

    @cached_property
    def snapshot(self) -> Snapshot:
        """The tables after reinforcement."""
        return self.effects()

    def changes(self, version: Version) -> Changes:
        """The reinforced rows of the stored version that was searched; only parts that hold some are read."""
        topics = cut_lineage(self.touched.groupBy("topic_id").agg(F.sum("n_visits").alias("n_visits"), F.sum("n_returns").alias("n_returns")))
        edges = cut_lineage(self.traversed)
        held = version.read("topics", version.parts_of("topics", topics, "topic_id")).join(
            broadcast_if_small(topics.select(F.col("topic_id").alias("id"))), "id", "left_semi")
        links = version.read("edges", version.parts_of("edges", edges)).join(
            broadcast_if_small(edges.select("from_topic", "to_topic")), ["from_topic", "to_topic"], "left_semi")
        return Changes(upserts={"topics": reinforce_topics(held, topics, self.boost, self.now),
                                "edges": reinforce_edges(links, edges, EDGE_REINFORCEMENT, self.now)})


def recall(snapshot: Snapshot, queries: DataFrame, config: SearchConfig = SearchConfig(), top_k: int = TOP_TOPICS,
           limit: int | None = None, as_of: AsOf = None, limits: SimilarityLimits = SimilarityLimits()) -> Recall:
    """Answer queries (query_id, query_embedding).

    Results: (query_id, rank, topic_id, topic_name, score, contents), contents
    best first.  A topic without instances is dropped after the cut at
    ``top_k``; ``limit`` cuts what is left.  All queries read the given
    snapshot, and the new one holds the sum of their effects.
    """
    now = clock(as_of)
    scored, traversed = search(queries, snapshot.topics, snapshot.edges, config, limits)
    scored = cut_lineage(scored)
    chosen = cut_lineage(top_topics(scored, top_k))
    best = top_instances(chosen, queries, snapshot.instances)
    filled = best.groupBy("query_id", "rank", "topic_id", "topic_name", "score").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("instance_rank", "content"))), lambda p: p["content"])
        .alias("contents"))
    order = Window.partitionBy("query_id").orderBy("rank")
    results = filled.withColumn("rank", F.row_number().over(order)).select(
        "query_id", "rank", "topic_id", "topic_name", "score", "contents")
    if limit:
        results = results.filter(F.col("rank") <= limit)
    touched = scored.select("topic_id", F.lit(1).alias("n_visits"), F.lit(0).alias("n_returns")).unionByName(
        chosen.select("topic_id", F.lit(0).alias("n_visits"), F.lit(1).alias("n_returns")))

    def effects() -> Snapshot:
        return snapshot.with_tables(
            topics=reinforce_topics(snapshot.topics, touched, config.strengthen_boost, now),
            edges=reinforce_edges(snapshot.edges, traversed, EDGE_REINFORCEMENT, now),
        )

    return Recall(results, scored, effects, touched, traversed, config.strengthen_boost, now)
