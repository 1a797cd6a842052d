"""Resolving topics, linking them and adding instances."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.config import REUSE_SIMILARITY, SearchConfig, SimilarityLimits
from fadegraph.functions.text import digest
from fadegraph.functions.vectors import relevance
from fadegraph.operators import vector_blocks as vb
from fadegraph.operators.identity import fresh_ids, repeat_number
from fadegraph.operators.leaders import HEAD_ROWS, choose_leaders
from fadegraph.operators.similarity import nearest
from fadegraph.operators.updates import AsOf
from fadegraph.schema import Snapshot, clock, complete, typed_like
from fadegraph.session import broadcast_if_small, cut_lineage


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Rows with a number that follows their order.

    The numbers are unique but have gaps: rows are counted per range of the
    order, so no task sees them all.  The result is written before it is used,
    so the ranges cannot shift.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    return ranged.withColumn(out, F.monotonically_increasing_id())


def number_entries(rows: DataFrame) -> DataFrame:
    """Topic-map rows with ``entry_ord``, the place of their topic in the import.

    Topics come file by file, and in a file by first position.
    """
    firsts = rows.groupBy("source_file", "topic").agg(F.min("ord").alias("first_ord"))
    placed = numbered(firsts, ["source_file", "first_ord", "topic"], "entry_ord")
    # Where topics are few, the texts of their rows are not shuffled.
    return rows.join(broadcast_if_small(placed.select("source_file", "topic", "entry_ord")), ["source_file", "topic"])


def unseen(candidates: DataFrame, instances: DataFrame) -> DataFrame:
    """Candidates (topic_id, digest, ...) whose content is not stored under their topic.

    The stored side is first cut down to what the candidates mention, so it
    need not be shuffled when the candidates are few.
    """
    keys = ["topic_id", "digest"]
    stored = instances.select("topic_id", digest(F.col("content")).alias("digest")).join(
        candidates.select(*keys), keys, "left_semi")
    return candidates.join(stored, keys, "left_anti")


def new_contents(candidates: DataFrame, instances: DataFrame) -> DataFrame:
    """Candidates (topic_id, content, ...) not stored under their topic yet."""
    return unseen(candidates.withColumn("digest", digest(F.col("content"))), instances).drop("digest")


def first_entry_only(candidates: DataFrame) -> DataFrame:
    """Of a content that several entries bring to a topic, the first entry's rows.

    Candidates are (topic_id, digest, entry_ord, ...).  Repeats inside the
    first entry stay.
    """
    keys = ["topic_id", "digest"]
    first = candidates.groupBy(*keys).agg(F.min("entry_ord").alias("entry_ord"))
    return candidates.join(first, [*keys, "entry_ord"], "left_semi")


def upsert_edges(edges: DataFrame, incoming: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Add edges (from_topic, to_topic, weight); a known edge keeps the larger weight."""
    keys = ["from_topic", "to_topic"]
    best = _best_offers(incoming)
    offered = best.select(*keys, F.col("weight").alias("_offered"))
    kept = edges.join(offered, keys, "left").select(*[
        F.greatest("weight", "_offered").alias(c) if c == "weight" else F.col(c) for c in edges.columns])
    return kept.unionByName(_fresh_edges(edges, best, as_of))


def _best_offers(incoming: DataFrame) -> DataFrame:
    return incoming.groupBy("from_topic", "to_topic").agg(F.max("weight").alias("weight"))


def _fresh_edges(edges: DataFrame, best: DataFrame, as_of: AsOf) -> DataFrame:
    keys = ["from_topic", "to_topic"]
    return complete(best.join(edges.select(*keys), keys, "left_anti"), "edges", as_of).select(*edges.columns)


def edge_changes(edges: DataFrame, incoming: DataFrame, as_of: AsOf = None) -> tuple[DataFrame, DataFrame]:
    """What ``upsert_edges`` changes: known edges whose weight rises, and edges that are new."""
    keys = ["from_topic", "to_topic"]
    best = _best_offers(incoming)
    raised = edges.join(best.select(*keys, F.col("weight").alias("_offered")), keys).filter(F.col("_offered") > F.col("weight"))
    return (raised.select(*[F.col("_offered").alias(c) if c == "weight" else F.col(c) for c in edges.columns]),
            _fresh_edges(edges, best, as_of))


def resolve_entries(entries: DataFrame, topics: DataFrame, config: SearchConfig = SearchConfig(),
                    limits: SimilarityLimits = SimilarityLimits(), head_rows: int = HEAD_ROWS) -> DataFrame:
    """Decide, in order, which entries reuse a topic and which create one.

    ``entries`` is (entry_ord, topic, topic_embedding).  An entry reuses the
    nearest topic that exists when its turn comes, if that is more than 0.9
    similar; topics of earlier entries exist as well.  Creating entries are
    therefore the leaders (operators.leaders) of those no stored topic covers.
    Result: (entry_ord, topic, topic_id, is_created, nearest_id, nearest_similarity);
    the last two are null at or below the similarity from which links are made,
    where nothing depends on them.
    """
    points = cut_lineage(vb.side(entries, F.col("entry_ord"), "topic_embedding", ord_=F.col("entry_ord")))
    stored = cut_lineage(
        nearest(points, vb.side(topics, "id", "topic_embedding"), 1, limits=limits)
        .select(F.col("l_id").alias("id"), F.col("r_id").alias("stored_id"), F.col("similarity").alias("stored_sim")))
    covered = stored.filter(F.col("stored_sim") > REUSE_SIMILARITY).select("id")
    leaders = cut_lineage(
        choose_leaders(points.join(covered, "id", "left_anti").select(*points.columns), REUSE_SIMILARITY, limits,
                       head_rows))
    lowest = min(REUSE_SIMILARITY, config.similarity_threshold) if config.auto_link else REUSE_SIMILARITY
    earlier = cut_lineage(nearest(points, leaders, 1, lowest, earlier=True, limits=limits).select(
        F.col("l_id").alias("id"), F.col("r_ord").alias("earlier_ord"), F.col("similarity").alias("earlier_sim")))
    directed = points.select("id", F.lit(True).alias("has_direction"))
    named = fresh_ids(repeat_number(entries.select("entry_ord", "topic"), ["topic"], "entry_ord"), "topic",
                      ["topic", "repeat_no"], topics.select("id"), "own_id")
    turned = (
        named.select("entry_ord", "topic", "own_id", F.col("entry_ord").cast("string").alias("id"))
        .join(directed, "id", "left").join(stored, "id", "left").join(earlier, "id", "left")
        .join(leaders.select("id", F.lit(True).alias("leads")), "id", "left")
    )
    made = turned.filter(F.col("leads") | F.col("has_direction").isNull()).select(
        F.col("entry_ord").alias("earlier_ord"), F.col("own_id").alias("earlier_id"))
    use_earlier = F.coalesce(F.col("earlier_sim") > F.coalesce("stored_sim", F.lit(-2.0)), F.lit(False))
    is_created = F.coalesce("leads", F.lit(False)) | F.col("has_direction").isNull()
    nearest_id = F.when(use_earlier, F.col("earlier_id")).otherwise(F.col("stored_id"))
    nearest_sim = F.when(use_earlier, F.col("earlier_sim")).otherwise(F.col("stored_sim"))
    known = nearest_sim > lowest
    return turned.join(made, "earlier_ord", "left").select(
        "entry_ord", "topic",
        F.when(is_created, F.col("own_id")).otherwise(nearest_id).alias("topic_id"),
        is_created.alias("is_created"), F.when(known, nearest_id).alias("nearest_id"),
        F.when(known, nearest_sim).alias("nearest_similarity"))


def link_edges(resolved: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Edges from the nearest topic to each created one, where similar enough."""
    if not config.auto_link:
        return resolved.limit(0).select(F.col("nearest_id").alias("from_topic"), F.col("topic_id").alias("to_topic"),
                                        F.col("nearest_similarity").alias("weight"))
    similar = F.col("nearest_similarity") > config.similarity_threshold
    return resolved.filter(F.col("is_created") & similar).select(
        F.col("nearest_id").alias("from_topic"), F.col("topic_id").alias("to_topic"),
        F.col("nearest_similarity").alias("weight"))


@dataclass(frozen=True)
class Ingested:
    """Outcome of an import: the new tables and what was added to them.

    ``added_instances`` is (entry_ord, inst_ord, id, topic_id, content,
    content_embedding, relevance_score).  ``new_topics`` and ``new_instances``
    are the rows added to the tables.
    """

    snapshot: Snapshot
    resolved: DataFrame
    added_instances: DataFrame
    added_edges: DataFrame
    report: DataFrame
    new_topics: DataFrame
    new_instances: DataFrame


def ingest(snapshot: Snapshot, entries: DataFrame, instances: DataFrame, config: SearchConfig = SearchConfig(),
           as_of: AsOf = None, limits: SimilarityLimits = SimilarityLimits(), head_rows: int = HEAD_ROWS,
           only_new: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """Add entries (entry_ord, topic, topic_embedding) with their instances.

    ``instances`` is (entry_ord, inst_ord, content, content_embedding), its
    first two columns being unique together.  An entry without instances is skipped before its topic is looked up.
    The report is (entry_ord, topic, is_added, n_added).  ``only_new`` picks
    of candidates (topic_id, digest, ...) those that are not stored; by default
    all stored contents are compared (sources.tables.unseen_in reads none).
    """
    now = clock(as_of)
    only_new = only_new or (lambda candidates: unseen(candidates, snapshot.instances))
    filled = entries.join(instances.select("entry_ord"), "entry_ord", "left_semi")
    resolved = cut_lineage(resolve_entries(filled, snapshot.topics, config, limits, head_rows))
    # Rows are chosen without their texts and vectors, which follow at the end.
    slim = instances.select("entry_ord", "inst_ord", digest(F.col("content")).alias("digest")).join(
        broadcast_if_small(resolved.select("entry_ord", "topic_id")), "entry_ord")
    chosen = first_entry_only(only_new(slim))
    chosen = fresh_ids(repeat_number(chosen, ["topic_id", "digest"], "inst_ord"), "instance", ["topic_id", "digest", "repeat_no"],
                       snapshot.instances.select("id")).select("entry_ord", "inst_ord", "topic_id", "id")
    # The entry's vector is joined first, so that texts are shuffled once.
    fresh = instances.join(chosen.join(filled.select("entry_ord", "topic_embedding"), "entry_ord"), ["entry_ord", "inst_ord"])
    added = cut_lineage(fresh.select(
        "entry_ord", "inst_ord", "id", "topic_id", "content", "content_embedding",
        relevance(F.col("topic_embedding"), F.col("content_embedding")).alias("relevance_score")))
    created = resolved.filter("is_created").join(filled.select("entry_ord", "topic_embedding"), "entry_ord").select(
        F.col("topic_id").alias("id"), F.col("topic").alias("topic_name"), "topic_embedding")
    links = link_edges(resolved, config)
    counts = added.groupBy("entry_ord").agg(F.count(F.lit(1)).alias("n_added"))
    report = (
        entries.select("entry_ord", "topic")
        .join(resolved.select("entry_ord", F.lit(True).alias("_resolved")), "entry_ord", "left")
        .join(counts, "entry_ord", "left")
        .select("entry_ord", "topic", F.coalesce("_resolved", F.lit(False)).alias("is_added"),
                F.coalesce("n_added", F.lit(0)).alias("n_added"))
    )
    new_topics = complete(created, "topics", now).select(*typed_like(snapshot.topics))
    new_instances = complete(added, "instances", now).select(*typed_like(snapshot.instances))
    after = snapshot.with_tables(
        topics=snapshot.topics.unionByName(new_topics, allowMissingColumns=True),
        instances=snapshot.instances.unionByName(new_instances, allowMissingColumns=True),
        edges=upsert_edges(snapshot.edges, links, now),
    )
    return Ingested(after, resolved, added, links, report, new_topics, new_instances)


def batch_summary(report: DataFrame) -> DataFrame:
    """One row: (n_entries, n_succeeded, all_succeeded)."""
    return report.agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_if("is_added").alias("n_succeeded"),
        ((F.count(F.lit(1)) > 0) & (F.count(F.lit(1)) == F.count_if("is_added"))).alias("all_succeeded"))
