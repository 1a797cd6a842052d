"""Triples to topic-map rows, and topic-map rows to arrays.

A topic map is kept as rows (source_file, topic, ord, instance).  The
strategies are then narrow projections or one counted join, and no topic,
however common, is gathered into one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadegraph.functions.text import strip

_ROW = ["source_file", "topic", "ord", "instance"]


def _words(*columns: str) -> Column:
    return F.concat_ws(" ", *columns)


def by_subject(triples: DataFrame) -> DataFrame:
    """Topic is the subject, instance "relation object"."""
    return triples.select(
        "source_file", F.col("subject").alias("topic"), F.col("triple_ord").alias("ord"),
        _words("relation", "object").alias("instance"))


def by_relation(triples: DataFrame) -> DataFrame:
    """Topic is the relation, instance the whole triple."""
    return triples.select(
        "source_file", F.col("relation").alias("topic"), F.col("triple_ord").alias("ord"),
        _words("subject", "relation", "object").alias("instance"))


def by_entity(triples: DataFrame) -> DataFrame:
    """Both ends are topics: the subject gets "relation object", the object "subject relation"."""
    ends = F.array(
        F.struct(F.col("subject").alias("topic"), (F.col("triple_ord") * 2).alias("ord"),
                 _words("relation", "object").alias("instance")),
        F.struct(F.col("object").alias("topic"), (F.col("triple_ord") * 2 + 1).alias("ord"),
                 _words("subject", "relation").alias("instance")),
    )
    return triples.select("source_file", F.inline(ends)).select(*_ROW)


def frequencies(triples: DataFrame, column: str) -> DataFrame:
    """Number of triples per file and value: (source_file, column, n_triples)."""
    return triples.groupBy("source_file", column).agg(F.count(F.lit(1)).alias("n_triples"))


def hybrid(triples: DataFrame, min_instances: int = 2) -> DataFrame:
    """By subject where the subject is frequent, else by relation where that is.

    Topics that end up with fewer than ``min_instances`` are dropped.  That can
    only befall a relation, when too few of its triples have a rare subject and
    no frequent subject of the same name makes up for it.  The joins are
    against the values that are too rare: a frequent value has no partner
    there, so it fans out to nothing.
    """
    subjects = frequencies(triples, "subject")
    rare = subjects.filter(F.col("n_triples") < min_instances).select("source_file", "subject", F.lit(True).alias("_rare"))
    frequent = subjects.filter(F.col("n_triples") >= min_instances).select(
        "source_file", F.col("subject").alias("relation"))
    flagged = triples.join(rare, ["source_file", "subject"], "left").withColumn(
        "_rare", F.coalesce("_rare", F.lit(False)))
    relations = flagged.groupBy("source_file", "relation").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_rare").alias("n_rare"))
    scarce = relations.filter(F.col("n") < min_instances).unionByName(
        relations.filter((F.col("n") >= min_instances) & (F.col("n_rare") < min_instances))
        .join(frequent, ["source_file", "relation"], "left_anti"))
    filed = flagged.join(
        scarce.select("source_file", "relation", F.lit(True).alias("_scarce")), ["source_file", "relation"], "left")
    to_relation = F.col("_rare")
    return filed.filter(~to_relation | F.col("_scarce").isNull()).select(
        "source_file", F.when(to_relation, F.col("relation")).otherwise(F.col("subject")).alias("topic"),
        F.col("triple_ord").alias("ord"),
        F.when(to_relation, _words("subject", "relation", "object")).otherwise(_words("relation", "object"))
        .alias("instance"))


def by_semantics(triples: DataFrame, embedder: Callable | None = None, n_clusters: int = 10) -> DataFrame:
    """One topic per KMeans cluster of the embedded triples (see operators.clusters)."""
    from fadegraph.operators.clusters import kmeans_topics

    if embedder is None:
        raise ValueError("the semantic strategy requires an embedder")
    return kmeans_topics(triples, embedder, n_clusters)


STRATEGIES = {
    "subject": by_subject,
    "relation": by_relation,
    "hybrid": hybrid,
    "semantic": by_semantics,
    "entity": by_entity,
}


def convert(triples: DataFrame, strategy: str = "subject", **options) -> DataFrame:
    """Apply a strategy by name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](triples, **options)


def ordered_distinct(rows: DataFrame, group: str, text: str, ord_: str) -> DataFrame:
    """Stripped texts without empty ones and repeats, at their first position."""
    clean = rows.withColumn(text, strip(F.col(text))).filter(F.col(text) != "")
    return clean.groupBy(group, text).agg(F.min(ord_).alias(ord_))


def topic_sizes(rows: DataFrame) -> DataFrame:
    """Per topic its number of instances and first position."""
    return rows.groupBy("source_file", "topic").agg(
        F.count(F.lit(1)).alias("n_instances"), F.min("ord").alias("first_ord"))


def topic_arrays(rows: DataFrame, width: int = 65_536) -> DataFrame:
    """Rows as arrays: (source_file, topic, chunk, first_ord, instances).

    A chunk covers ``width`` positions of its file, so an array has at most
    about that many texts; a topic's chunks in order are its whole list.
    """
    placed = rows.withColumn("chunk", F.floor(F.col("ord") / F.lit(width)).cast("long"))
    return placed.groupBy("source_file", "topic", "chunk").agg(
        F.min("ord").alias("first_ord"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "instance"))), lambda p: p["instance"])
        .alias("instances"))
