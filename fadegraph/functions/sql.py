"""The memory inside ``spark.sql``: its tables as views, and functions over them.

``register`` makes temporary SQL functions, so they are expanded into the query
that calls them and Catalyst plans both together.  Table functions may be
called laterally, once for each row of another table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from fadegraph.schema import Snapshot

# Scalar functions; what they compute is what functions.scoring and functions.vectors compute.  {m} stands for the prefix.
_SCALARS = {
    "elapsed_days(since TIMESTAMP_NTZ, until TIMESTAMP_NTZ)": (
        "DOUBLE", "(unix_micros(cast(until AS TIMESTAMP)) - unix_micros(cast(since AS TIMESTAMP))) / 86400000000D"),
    "half_life_decay(value DOUBLE, days DOUBLE, half_life DOUBLE)": ("DOUBLE", "value * power(0.5D, days / half_life)"),
    "clamp_add(value DOUBLE, gain DOUBLE)": ("DOUBLE", "least(value + gain, 1D)"),
    "node_size(strength DOUBLE, access_count INT)": ("DOUBLE", "strength * (1D + log1p(cast(access_count AS DOUBLE)))"),
    "instance_rank(similarity DOUBLE, relevance DOUBLE, importance DOUBLE)": ("DOUBLE", "similarity * relevance * importance"),
    "dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE", "CASE WHEN {m}_dot(a, a) > 0 AND {m}_dot(b, b) > 0 THEN "
        "greatest(-1D, least(1D, {m}_dot(a, b) / (sqrt({m}_dot(a, a)) * sqrt({m}_dot(b, b))))) END"),
}

# Table functions over the views of the memory.
_TABLES = {
    "topic_neighbors(topic STRING, min_weight DOUBLE DEFAULT 0.3)": (
        "topic_id STRING, neighbor_id STRING, neighbor_name STRING, edge_weight DOUBLE",
        "SELECT e.from_topic, t.id, t.topic_name, e.weight FROM {m}_edges e JOIN {m}_topics t ON e.to_topic = t.id "
        "WHERE e.from_topic = topic AND e.weight >= min_weight"),
    "orphan_topics(below DOUBLE DEFAULT 0.3)": (
        "id STRING, topic_name STRING, strength DOUBLE",
        "SELECT t.id, t.topic_name, t.strength FROM {m}_topics t LEFT ANTI JOIN "
        "(SELECT from_topic AS linked FROM {m}_edges UNION ALL SELECT to_topic FROM {m}_edges) ON t.id = linked WHERE t.strength < below"),
    "decayed_topics(as_of TIMESTAMP_NTZ)": (
        "id STRING, strength DOUBLE, decayed_strength DOUBLE",
        "SELECT id, greatest(decayed, 0.01D), decayed FROM (SELECT id, {m}_half_life_decay(strength, {m}_elapsed_days(last_accessed, as_of), "
        "half_life_days) AS decayed FROM {m}_topics)"),
    "weak_topics(as_of TIMESTAMP_NTZ, threshold DOUBLE DEFAULT 0.05)": (
        "id STRING", "SELECT t.id FROM {m}_topics t JOIN {m}_decayed_topics(as_of) d ON d.id = t.id WHERE d.strength < threshold "
        "AND t.last_accessed < as_of - INTERVAL 30 DAYS AND t.access_count < 5"),
}


def register(spark: SparkSession, snapshot: Snapshot, prefix: str = "memory") -> list[str]:
    """Make views and functions of a memory, all with the prefix; gives the names of the functions.

    Calling it again with the prefix puts them over another snapshot.
    """
    for name in ("topics", "instances", "edges"):
        getattr(snapshot, name).createOrReplaceTempView(f"{prefix}_{name}")
    names = []
    for head, (kind, body) in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{head} RETURNS {kind} RETURN {body.format(m=prefix)}")
        names.append(f"{prefix}_{head.split('(')[0]}")
    for head, (columns, body) in _TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{head} RETURNS TABLE({columns}) RETURN {body.format(m=prefix)}")
        names.append(f"{prefix}_{head.split('(')[0]}")
    return names
