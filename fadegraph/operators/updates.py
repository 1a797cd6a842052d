"""Forgetting and reinforcement, as new versions of the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fadegraph.functions import scoring
from fadegraph.functions.vectors import cosine_distance
from fadegraph.schema import Snapshot, clock
from fadegraph.session import broadcast_if_small, cut_lineage

AsOf = str | Column | None


@dataclass(frozen=True)
class Counted:
    """A changed table that counts the rows it changes while it is written or otherwise read once."""

    rows: DataFrame
    observation: Observation

    @property
    def n_affected(self) -> int:
        """Changed rows; waits for the first action on ``rows`` to end."""
        return self.observation.get["n_affected"]


def _counting(rows: DataFrame, affected: Column) -> tuple[DataFrame, Observation]:
    observation = Observation()
    return rows.observe(observation, F.count_if(affected).alias("n_affected")), observation


def decay_topics(topics: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Halve strength every ``half_life_days`` since the last access, floor 0.01.

    The result has one more column, ``decayed_strength``: the value before the
    floor.  ``last_accessed`` stays, so decaying twice counts the time twice.
    """
    days = scoring.elapsed_days(F.col("last_accessed"), clock(as_of))
    decayed = scoring.half_life_decay(F.col("strength"), days, F.col("half_life_days"))
    return topics.withColumn("decayed_strength", decayed).withColumn(
        "strength", F.greatest("decayed_strength", F.lit(0.01)))


def decay_to(topics: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Decay that can be repeated: time is counted from the ``decayed_at`` column."""
    now = clock(as_of)
    since = F.col("last_accessed")
    if "decayed_at" in topics.columns:
        since = F.greatest(since, F.coalesce("decayed_at", "last_accessed"))
    decayed = scoring.half_life_decay(F.col("strength"), scoring.elapsed_days(since, now), F.col("half_life_days"))
    return topics.withColumn("strength", F.greatest(decayed, F.lit(0.01))).withColumn("decayed_at", now)


def decay_idle_edges(edges: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Halve weight per 7 idle days, floor 0.01, for edges idle over a day.

    Column ``is_decayed`` marks the changed rows; count it for the number.
    """
    now = clock(as_of)
    idle = F.col("last_activated") < now - F.expr("interval 1 day")
    decayed = scoring.half_life_decay(
        F.col("weight"), scoring.elapsed_days(F.col("last_activated"), now), F.lit(7.0))
    return edges.withColumn("is_decayed", idle).withColumn(
        "weight", F.when(idle, F.greatest(decayed, F.lit(0.01))).otherwise(F.col("weight")))


def decay_idle_edges_counted(edges: DataFrame, as_of: AsOf = None) -> Counted:
    """``decay_idle_edges`` with the number of decayed edges, from one scan."""
    rows, observation = _counting(decay_idle_edges(edges, as_of), F.col("is_decayed"))
    return Counted(rows.drop("is_decayed"), observation)


def strengthen_topics(topics: DataFrame, accesses: DataFrame, boost: float = 0.1, as_of: AsOf = None) -> DataFrame:
    """Apply accesses (topic_id, n_accesses, last_access) to the topics.

    Each access adds ``boost`` up to 1 and lengthens the half-life by 10 %.
    Capped gains commute, so n accesses are one step.  ``last_access`` null
    stands for ``as_of``.
    """
    hits = accesses.groupBy(F.col("topic_id").alias("_topic")).agg(
        F.sum("n_accesses").alias("_n"), F.max("last_access").alias("_last"))
    joined = topics.join(hits, topics.id == F.col("_topic"), "left")
    n = F.coalesce("_n", F.lit(0))
    hit = n > 0
    changes = {
        "strength": scoring.clamp_add(F.col("strength"), n * F.lit(boost)),
        "access_count": (F.col("access_count") + n).cast("int"),
        "last_accessed": F.greatest("last_accessed", F.coalesce("_last", clock(as_of))),
        "half_life_days": F.col("half_life_days") * F.pow(F.lit(1.1), n),
    }
    return joined.select(*[
        F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in topics.columns])


def count_accesses(log: DataFrame) -> DataFrame:
    """Fold an access log (topic_id, ts) into (topic_id, n_accesses, last_access)."""
    return log.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_accesses"), F.max("ts").alias("last_access"))


def reinforce_topics(topics: DataFrame, touched: DataFrame, boost: float, as_of: AsOf = None) -> DataFrame:
    """Effects of searches: touched (topic_id, n_visits, n_returns).

    A visit adds half the boost, a return the boost and one access.
    """
    hits = broadcast_if_small(cut_lineage(touched.groupBy(F.col("topic_id").alias("_topic")).agg(
        F.sum("n_visits").alias("_visits"), F.sum("n_returns").alias("_returns"))))
    joined = topics.join(hits, topics.id == F.col("_topic"), "left")
    gain = F.col("_visits") * F.lit(boost * 0.5) + F.col("_returns") * F.lit(boost)
    changes = {
        "strength": scoring.clamp_add(F.col("strength"), gain),
        "access_count": (F.col("access_count") + F.col("_returns")).cast("int"),
        "last_accessed": clock(as_of),
    }
    hit = F.col("_topic").isNotNull()
    return joined.select(*[
        F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in topics.columns])


def reinforce_edges(edges: DataFrame, traversed: DataFrame, gain: float, as_of: AsOf = None) -> DataFrame:
    """Add ``gain`` per traversal (from_topic, to_topic, n_traversals), up to 1."""
    hits = broadcast_if_small(cut_lineage(traversed.select(
        F.col("from_topic").alias("_from"), F.col("to_topic").alias("_to"), F.col("n_traversals").alias("_n"))))
    joined = edges.join(hits, (edges.from_topic == F.col("_from")) & (edges.to_topic == F.col("_to")), "left")
    hit = F.col("_n").isNotNull()
    changes = {
        "weight": scoring.clamp_add(F.col("weight"), F.col("_n") * F.lit(gain)),
        "last_activated": clock(as_of),
    }
    return joined.select(*[
        F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in edges.columns])


def cascade(snapshot: Snapshot, gone: DataFrame) -> Snapshot:
    """Remove topics and, with them, their instances and edges.

    The removed ids are written once; when few, the tables are not shuffled.
    """
    ids = broadcast_if_small(cut_lineage(gone.select(F.col("id").alias("gone_id"))))
    return snapshot.with_tables(
        topics=snapshot.topics.join(ids, F.col("id") == F.col("gone_id"), "left_anti"),
        instances=snapshot.instances.join(ids, F.col("topic_id") == F.col("gone_id"), "left_anti"),
        edges=snapshot.edges.join(ids, F.col("from_topic") == F.col("gone_id"), "left_anti")
        .join(ids, F.col("to_topic") == F.col("gone_id"), "left_anti"),
    )


def weak_topics(topics: DataFrame, threshold: float = 0.05, as_of: AsOf = None) -> DataFrame:
    """Topics below ``threshold``, idle over 30 days and accessed under 5 times."""
    return topics.filter(_is_weak(threshold, clock(as_of)))


def _is_weak(threshold: float, now: Column) -> Column:
    idle = F.col("last_accessed") < now - F.expr("interval 30 days")
    return F.coalesce((F.col("strength") < threshold) & idle & (F.col("access_count") < 5), F.lit(False))


def evict(snapshot: Snapshot, threshold: float = 0.05, as_of: AsOf = None) -> tuple[Snapshot, DataFrame]:
    """Decay all topics, then remove the weak ones: (new snapshot, removed topics)."""
    decayed = decay_topics(snapshot.topics, as_of).drop("decayed_strength")
    gone = weak_topics(decayed, threshold, as_of)
    return cascade(snapshot.with_tables(topics=decayed), gone), gone


def evict_counted(snapshot: Snapshot, threshold: float = 0.05, as_of: AsOf = None) -> tuple[Snapshot, Counted]:
    """``evict`` with the number of removed topics.

    The topics are read once: the write that keeps the others counts the weak
    ones.  Instances and edges need their ids, which are narrow.
    """
    now = clock(as_of)
    decayed = decay_topics(snapshot.topics, now).drop("decayed_strength")
    is_weak = _is_weak(threshold, now)
    rows, observation = _counting(decayed, is_weak)
    kept = rows.filter(~is_weak)
    return cascade(snapshot, weak_topics(decayed, threshold, now)).with_tables(topics=kept), Counted(kept, observation)


def fade_edges(edges: DataFrame) -> DataFrame:
    """Flat decay by 5 % of the edges above 0.1."""
    return edges.withColumn(
        "weight", F.when(F.col("weight") > 0.1, F.col("weight") * 0.95).otherwise(F.col("weight")))


def prune_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(~(F.col("weight") < 0.05))


def prune_edges_counted(edges: DataFrame) -> Counted:
    """``prune_edges`` with the number of removed edges, from one scan."""
    rows, observation = _counting(edges, F.col("weight") < 0.05)
    return Counted(prune_edges(rows), observation)


def rescore_importance(instances: DataFrame, topics: DataFrame, as_of: AsOf = None) -> DataFrame:
    """New importance from recency, relevance and distance to the topic."""
    homes = topics.select(F.col("id").alias("_home"), F.col("topic_embedding").alias("_home_vector"))
    joined = instances.join(homes, instances.topic_id == F.col("_home"), "left")
    score = scoring.importance_score(
        scoring.whole_days(F.col("last_accessed"), clock(as_of)), F.col("relevance_score"),
        cosine_distance(F.col("content_embedding"), F.col("_home_vector")))
    return joined.select(*[score.alias(c) if c == "importance" else F.col(c) for c in instances.columns])


def touch_topics(topics: DataFrame, accessed: DataFrame) -> DataFrame:
    """A topic is as recently accessed as its latest instance (topic_id, last_accessed)."""
    latest = accessed.groupBy(F.col("topic_id").alias("_topic")).agg(F.max("last_accessed").alias("_latest"))
    joined = topics.join(latest, topics.id == F.col("_topic"), "left")
    return joined.select(*[
        F.greatest("last_accessed", "_latest").alias(c) if c == "last_accessed" else F.col(c)
        for c in topics.columns])
