"""Clustering of texts into topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fadegraph.config import SimilarityLimits
from fadegraph.functions.embed import embed_with
from fadegraph.functions.vectors import cosine_or_zero, group_mean, l2_distance
from fadegraph.operators import vector_blocks as vb
from fadegraph.operators.leaders import choose_leaders
from fadegraph.operators.similarity import nearest
from fadegraph.session import broadcast_if_small, cut_lineage

_TOPIC_NAME_LENGTH = 80
# Parts of a cluster that look for its best member on their own.
_SALTS = 16


def _nearest_centre(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds ``cluster`` and ``gap``: the nearest of the file's centres, the first of equals.

    A file's centres are one row with an array of at most ``n_clusters``
    vectors, so a file of any size is joined without being gathered.
    """
    one = centres.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("_centres"))
    ranked = F.transform("_centres", lambda c: F.struct(
        F.round(l2_distance(F.col("embedding"), c["centre"]), 12).alias("gap"), c["cluster"].alias("cluster")))
    best = points.join(broadcast_if_small(one), "source_file").withColumn("_best", F.array_min(ranked))
    return best.withColumns({"cluster": F.col("_best.cluster"), "gap": F.col("_best.gap")}).drop("_centres", "_best")


def kmeans_topics(triples: DataFrame, embedder, n_clusters: int = 10, max_iter: int = 10) -> DataFrame:
    """Topic-map rows with one topic per KMeans cluster of each file.

    Each file has clusters of its own, as many as ``n_clusters`` or as it has
    different vectors.  The first centres are its first different vectors by
    ``triple_ord``; each of ``max_iter`` Lloyd steps, for all files together,
    assigns and takes means, and a cluster that loses its members is gone.  A
    cluster is named by the subject of the triple nearest to its last centre.
    ``embedder`` is a callable on texts, or an object whose ``add(DataFrame,
    text column)`` adds column ``embedding``.
    """
    texts = triples.withColumn("instance", F.concat_ws(" ", "subject", "relation", "object"))
    embedded = embedder.add(texts, "instance") if hasattr(embedder, "add") else embed_with(texts, "instance", embedder)
    points = cut_lineage(embedded.withColumn("embedding", F.col("embedding").cast("array<double>")))
    different = points.groupBy("source_file", "embedding").agg(F.min("triple_ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("ord"))
    centres = different.withColumn("cluster", place).filter(F.col("cluster") <= n_clusters).select(
        "source_file", "cluster", F.col("embedding").alias("centre"))
    for _ in range(max_iter):
        moved = _nearest_centre(points, cut_lineage(centres))
        centres = group_mean(moved, ["source_file", "cluster"], "embedding", "centre")
    labelled = cut_lineage(_nearest_centre(points, cut_lineage(centres)))
    names = labelled.groupBy("source_file", "cluster").agg(
        F.min_by("subject", F.struct("gap", "triple_ord")).alias("topic"))
    return labelled.join(broadcast_if_small(names), ["source_file", "cluster"]).select(
        "source_file", "topic", F.col("triple_ord").alias("ord"), "instance")


def leader_clusters(texts: DataFrame, threshold: float = 0.7,
                    limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """Order-dependent clusters with fixed leaders, over all files at once.

    A text becomes a leader when no earlier leader is more than ``threshold``
    similar; every other text joins its most similar earlier leader.
    ``ord`` must be unique over all texts.
    Result: (source_file, ord, text, embedding, cluster), cluster = the leader's ord.
    """
    points = vb.side(texts, F.col("ord"), "embedding", ord_=F.col("ord"))
    leaders = choose_leaders(points, threshold, limits)
    members = nearest(points, leaders, 1, threshold, earlier=True, limits=limits)
    homes = members.select(F.col("l_id").alias("_id"), F.col("r_ord").alias("_leader"))
    return texts.join(homes, texts.ord.cast("string") == F.col("_id"), "left").select(
        "source_file", "ord", "text", "embedding", F.coalesce("_leader", "ord").alias("cluster"))


def cluster_topics(clusters: DataFrame, min_instances: int = 1) -> DataFrame:
    """Topic-map rows of clustered texts.

    The topic is the member nearest to the mean (the first of equals), cut to
    80 characters; clusters below ``min_instances`` are dropped.
    """
    keys = ["source_file", "cluster"]
    means = group_mean(clusters, keys, "embedding", "centre").join(
        clusters.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_instances), keys)
    near = F.round(cosine_or_zero(F.col("embedding"), F.col("centre")), 12)
    # The best of each salted part first: the join leaves rows dealt by the keys alone.
    salt = F.pmod(F.xxhash64("ord"), F.lit(_SALTS))
    parts = clusters.withColumn("salt", salt).join(
        broadcast_if_small(cut_lineage(means)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), [*keys, "salt"])
    best = parts.groupBy(*keys, "salt").agg(F.min_by(F.struct("text"), F.struct(-near, F.col("ord"))).alias("best"),
                                            F.min(F.struct(-near, F.col("ord"))).alias("at"))
    names = cut_lineage(best.groupBy(*keys).agg(F.min_by("best.text", "at").alias("name")))
    return clusters.join(broadcast_if_small(names), keys).select(
        "source_file", F.substring("name", 1, _TOPIC_NAME_LENGTH).alias("topic"), "cluster", "ord",
        F.col("text").alias("instance"))
