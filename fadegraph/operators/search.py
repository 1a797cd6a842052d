"""Breadth-first search from the nearest topics, for many queries at once."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fadegraph.config import ENTRY_POINTS, MIN_SCORE, TOP_INSTANCES, SearchConfig, SimilarityLimits
from fadegraph.functions.scoring import instance_rank
from fadegraph.functions.vectors import cosine_of_dot, cosine_of_normed, norm
from fadegraph.operators import vector_blocks as vb
from fadegraph.operators.graph import ranked_edges
from fadegraph.operators.similarity import nearest
from fadegraph.session import broadcast_if_small, cut_lineage

# Instances of a topic that one task ranks.
INSTANCE_BLOCK = 10_000
# Visits of one block of queries, of which a block of topics has its share.
_VISIT_ROWS = 4_000_000


def nearest_topics(queries: DataFrame, topics: DataFrame, k: int = ENTRY_POINTS,
                   limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    """The k topics nearest to each query: (query_id, topic_id, similarity, rank)."""
    found = nearest(vb.side(queries, "query_id", "query_embedding"), vb.side(topics, "id", "topic_embedding"),
                    k, limits=limits)
    return found.select(
        F.col("l_id").alias("query_id"), F.col("r_id").alias("topic_id"), "similarity", "rank")


def reach(entries: DataFrame, followed: DataFrame, max_depth: int) -> DataFrame:
    """Topics each query reaches: (query_id, topic_id, depth, path, path_strength).

    A queue served first come first served finishes a depth before the next
    begins, and within a depth it follows the order of the parents and then of
    their edges.  ``path`` (entry rank, then edge ranks) sorts just so, and the
    lowest path to a topic is the first arrival.  Each depth is one join and
    one grouping for all queries, written out so that the next starts from it.
    """
    level = cut_lineage(entries.select(
        "query_id", "topic_id", F.lit(0).alias("depth"), F.array(F.col("rank").cast("int")).alias("path"),
        F.col("similarity").alias("path_strength")))
    levels = [level]
    for depth in range(1, max_depth + 1):
        steps = level.join(followed, F.col("topic_id") == F.col("from_topic")).select(
            "query_id", F.col("to_topic").alias("topic_id"),
            F.concat("path", F.array(F.col("edge_rank").cast("int"))).alias("path"),
            (F.col("path_strength") * F.col("weight")).alias("path_strength"))
        first = steps.groupBy("query_id", "topic_id").agg(F.min(F.struct("path", "path_strength")).alias("first"))
        seen = reduce(DataFrame.unionByName, levels).select("query_id", "topic_id")
        level = cut_lineage(first.join(seen, ["query_id", "topic_id"], "left_anti").select(
            "query_id", "topic_id", F.lit(depth).alias("depth"), "first.path", "first.path_strength"))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def _normed(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "query_embedding", norm(F.col("query_embedding")).alias("query_norm"))


def _dots(left: pa.ListArray, right: pa.ListArray, at: np.ndarray, other: np.ndarray) -> pa.Array:
    """Product of each pair of vectors, added up in the order of their components; null where widths differ."""
    (a, a_from), (b, b_from) = ((np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64), np.asarray(v.offsets)) for v in (left, right))
    widths, others = np.diff(a_from)[at], np.diff(b_from)[other]
    total = np.zeros(len(at))
    with np.errstate(all="ignore"):
        for width in np.unique(widths):
            rows = np.flatnonzero((widths == width) & (others == width))
            starts, ends = a_from[at[rows]], b_from[other[rows]]
            part = np.zeros(len(rows))
            for i in range(width):
                part += a[starts + i] * b[ends + i]
            total[rows] = part
    return pa.array(total, mask=widths != others)


def stacked(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts; a list that a part does not have is empty in its rows.

    Spark measures a batch for Python after each row, and goes back over all null lists in front of it to do so.
    """
    lists = {f.name: f.dataType for p in parts for f in p.schema if isinstance(f.dataType, T.ArrayType)}
    filled = [p.withColumns({n: F.array().cast(kind) for n, kind in lists.items() if n not in p.columns}) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), filled)


def with_products(visited: DataFrame, topics: DataFrame, queries: DataFrame) -> DataFrame:
    """Visits (query_id, topic_id, ...) joined with both tables, without the column ``vec``, and with ``product`` of the two.

    ``topics`` is (topic_id, vec, ...), ``queries`` (query_id, vec, ...).  A vector is sent once to each block
    of the other side and not once for each visit, so what is shuffled of vectors does not grow with the visits.
    """

    def size(rows: DataFrame) -> int:
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")).first()
        return vb.ways_of(found["n"], found["width"])

    topic_ways, query_ways = size(topics), max(size(queries), math.ceil(visited.count() / _VISIT_ROWS))

    def block(id_: str, ways: int) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(ways)).cast("int")

    def every(ways: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))

    parts = [
        visited.select("*", F.lit(0).alias("_kind"), block("topic_id", topic_ways).alias("_i"), block("query_id", query_ways).alias("_j")),
        topics.select("*", F.lit(1).alias("_kind"), block("topic_id", topic_ways).alias("_i"), every(query_ways).alias("_j")),
        queries.select("*", F.lit(2).alias("_kind"), every(topic_ways).alias("_i"), block("query_id", query_ways).alias("_j")),
    ]
    met = stacked(parts)
    of_topic = [c for c in topics.columns if c not in ("topic_id", "vec")]
    of_query = [c for c in queries.columns if c not in ("query_id", "vec")]
    names = [*visited.columns, *of_topic, *of_query]
    schema = T.StructType([T.StructField(n, met.schema[n].dataType) for n in names] + [T.StructField("product", T.DoubleType())])

    def run(group: pa.Table) -> pa.Table:
        kind = np.asarray(group.column("_kind"))
        visits, near, asked = (group.filter(pa.array(kind == k)) for k in range(3))
        keys = pa.table({"topic_id": visits.column("topic_id"), "query_id": visits.column("query_id"), "v": np.arange(visits.num_rows)})
        pairs = keys.join(pa.table({"topic_id": near.column("topic_id"), "t": np.arange(near.num_rows)}), "topic_id", join_type="inner", use_threads=False).join(
            pa.table({"query_id": asked.column("query_id"), "q": np.arange(asked.num_rows)}), "query_id", join_type="inner", use_threads=False)
        v, t, q = (np.asarray(pairs.column(c), dtype=np.int64) for c in "vtq")
        product = _dots(near.column("vec").combine_chunks(), asked.column("vec").combine_chunks(), t, q)
        columns = [table.column(c).take(pa.array(at)) for table, at, held in (
            (visits, v, visited_columns), (near, t, of_topic), (asked, q, of_query)) for c in held]
        return pa.table([*columns, product], names=[*names, "product"])

    visited_columns = visited.columns
    return met.groupBy("_i", "_j").applyInArrow(run, schema)


def search(queries: DataFrame, topics: DataFrame, edges: DataFrame, config: SearchConfig = SearchConfig(),
           limits: SimilarityLimits = SimilarityLimits()) -> tuple[DataFrame, DataFrame]:
    """Visited topics with their scores, and the edges followed.

    Visited: (query_id, topic_id, topic_name, depth, path, path_strength,
    similarity, strength, score, is_result).  Followed: (from_topic, to_topic,
    n_traversals), an edge counting even when its end was seen or too deep.
    """
    followed = ranked_edges(edges, config).filter(~F.col("is_dropped"))
    followed = broadcast_if_small(cut_lineage(followed.select("from_topic", "to_topic", "weight", "edge_rank")))
    visited = reach(nearest_topics(queries, topics, ENTRY_POINTS, limits), followed, config.max_depth)
    vector = lambda c: F.col(c).cast("array<double>").alias("vec")
    paired = with_products(
        visited, topics.select(F.col("id").alias("topic_id"), "topic_name", "strength", vector("topic_embedding"),
                               norm(F.col("topic_embedding")).alias("topic_norm")),
        queries.select("query_id", vector("query_embedding"), norm(F.col("query_embedding")).alias("query_norm")))
    scored = (
        paired.withColumn("similarity", cosine_of_dot(F.col("product"), F.col("query_norm"), F.col("topic_norm")))
        .withColumn("score", F.col("similarity") * F.col("strength") * F.col("path_strength"))
        .select("query_id", "topic_id", "topic_name", "depth", "path", "path_strength", "similarity", "strength",
                "score", F.coalesce(F.col("score") > MIN_SCORE, F.lit(False)).alias("is_result"))
    )
    traversed = (
        visited.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_traversals"))
        .join(followed, F.col("topic_id") == F.col("from_topic"))
        .select("from_topic", "to_topic", "n_traversals")
    )
    return scored, traversed


def top_topics(scored: DataFrame, top_k: int) -> DataFrame:
    """The best results per query: adds ``rank``; equal scores keep visiting order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "depth", "path")
    results = scored.filter("is_result").select("query_id", "topic_id", "topic_name", "score", "depth", "path")
    return results.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def top_instances(chosen: DataFrame, queries: DataFrame, instances: DataFrame, n: int = TOP_INSTANCES,
                  block_rows: int = INSTANCE_BLOCK) -> DataFrame:
    """The n best instances per chosen (query_id, topic_id): adds instance columns and ``instance_rank``.

    Instances of a topic are dealt to blocks of about ``block_rows``, so a
    topic that holds most of them is many tasks; each block gives its n best
    without texts, and only the final ones fetch theirs.
    """
    chosen = cut_lineage(chosen)  # used three times; the search behind it runs once
    wanted = cut_lineage(chosen.select("topic_id").distinct())
    held = instances.select(F.col("id").alias("instance_id"), "topic_id", "content_embedding", "relevance_score", "importance").join(
        wanted, "topic_id", "left_semi")
    blocks = cut_lineage(held.groupBy("topic_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks")))
    shape = broadcast_if_small(blocks)
    dealt = held.join(shape, "topic_id").withColumn("_block", F.pmod(F.xxhash64("instance_id"), "_blocks")).drop("_blocks")
    asked = chosen.select("query_id", "topic_id").distinct().join(_normed(queries), "query_id").join(shape, "topic_id").withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_blocks")
    scored = asked.join(dealt, ["topic_id", "_block"]).select(
        "query_id", "topic_id", "_block", "instance_id", instance_rank(
            cosine_of_normed(F.col("query_embedding"), F.col("content_embedding"), F.col("query_norm"), norm(F.col("content_embedding"))),
            F.col("relevance_score"), F.col("importance")).alias("instance_score"))
    # A vector without length has no score; such rows come first, as NaN does
    # in a descending order that treats it as the greatest number.
    best = [F.col("instance_score").desc_nulls_first(), F.col("instance_id")]
    within = F.row_number().over(Window.partitionBy("query_id", "topic_id", "_block").orderBy(*best))
    ranked = scored.withColumn("_place", within).filter(F.col("_place") <= n).drop("_place", "_block")
    place = F.row_number().over(Window.partitionBy("query_id", "topic_id").orderBy(*best))
    winners = ranked.withColumn("instance_rank", place).filter(F.col("instance_rank") <= n)
    texts = instances.select(F.col("id").alias("instance_id"), "content")
    return chosen.join(winners, ["query_id", "topic_id"]).join(texts, "instance_id").select(
        *chosen.columns, "instance_id", "content", "instance_score", "instance_rank")
