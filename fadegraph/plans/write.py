"""From topic-map rows to an import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.config import SearchConfig, SimilarityLimits
from fadegraph.operators.aggregate import by_relation, ordered_distinct
from fadegraph.operators.clusters import cluster_topics, leader_clusters
from fadegraph.operators.ingest import Ingested, edge_changes, ingest, number_entries, numbered
from fadegraph.operators.updates import AsOf
from fadegraph.schema import Snapshot, clock
from fadegraph.session import cut_lineage
from fadegraph.sources.tables import Changes, Version, unseen_in

# Adds a vector column to a table: (table, text column, name of the new column).
AddVectors = Callable[[DataFrame, str, str], DataFrame]


def remember(snapshot: Snapshot, rows: DataFrame, add_vectors: AddVectors, config: SearchConfig = SearchConfig(),
             as_of: AsOf = None, limits: SimilarityLimits = SimilarityLimits(),
             only_new: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """Import topic-map rows (source_file, topic, ord, instance)."""
    placed = cut_lineage(number_entries(rows))
    topics = placed.select("entry_ord", "topic").distinct()
    entries = cut_lineage(add_vectors(topics, "topic", "topic_embedding"))
    instances = cut_lineage(add_vectors(
        placed.select("entry_ord", F.col("ord").alias("inst_ord"), F.col("instance").alias("content")),
        "content", "content_embedding"))
    return ingest(snapshot, entries, instances, config, as_of, limits, only_new=only_new)


def remember_changes(version: Version, rows: DataFrame, add_vectors: AddVectors, config: SearchConfig = SearchConfig(),
                     as_of: AsOf = None, limits: SimilarityLimits = SimilarityLimits()) -> Changes:
    """What importing topic-map rows changes in a stored version, for ``save_changes``.

    Stored contents are not read: digests and their filters tell what is new.
    """
    now = clock(as_of)
    done = remember(version.snapshot, rows, add_vectors, config, now, limits, lambda candidates: unseen_in(version, candidates))
    links = cut_lineage(done.added_edges)
    near = version.read("edges", version.parts_of("edges", links))
    raised, fresh = edge_changes(near, links, now)
    return Changes(inserts={"topics": done.new_topics, "instances": done.new_instances, "edges": fresh}, upserts={"edges": raised})


def semantic_rows(texts: DataFrame, add_vectors: AddVectors, threshold: float = 0.7, min_instances: int = 1,
                  limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """Topic-map rows of texts (source_file, ord, text) grouped by meaning.

    ``ord`` of the result orders topics by cluster and then texts.
    """
    distinct = ordered_distinct(texts, "source_file", "text", "ord")
    # Positions repeat from file to file; leaders need one order over all.
    distinct = numbered(distinct, ["source_file", "ord"], "place").drop("ord").withColumnRenamed("place", "ord")
    embedded = cut_lineage(add_vectors(distinct, "text", "embedding"))
    clusters = leader_clusters(embedded, threshold, limits)
    return cluster_topics(cut_lineage(clusters), min_instances).select(
        "source_file", "topic", "cluster", "ord", "instance")


def relation_texts(triples: DataFrame) -> DataFrame:
    """The texts that a semantic import of triples clusters: (source_file, ord, text)."""
    return by_relation(triples).select("source_file", "ord", F.col("instance").alias("text"))
