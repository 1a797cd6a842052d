"""One query per operator, each over the whole given tables.

A query named ``<id>_<word>`` shows one operator.  ``ORACLES`` holds the same
result in DuckDB SQL.  Numbers are rounded to 6 digits on both sides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fadegraph import SearchConfig, SimilarityLimits, Snapshot
from fadegraph.functions import scoring, sql, vectors
from fadegraph.functions.embed import embed_hashed
from fadegraph.operators import (
    aggregate, approximate, clusters, density, density_update, discover, graph, ingest, merge, search, similarity, updates)
from fadegraph.operators import vector_blocks as vb
from fadegraph.plans.maintain import maintain
from fadegraph.plans.read import recall
from fadegraph.schema import clock, complete, vector_width, violations, width_violations
from fadegraph.session import cut_lineage, ensure_checkpoint_dir, written
from fadegraph.sources import openie, tables, tabular, topic_map
from fadegraph.streaming import fading, loops
from fixtures import AS_OF, DUCKDB_SQL, SPARK_SQL

_BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
         "conversations").split()

# Limits so small that the given tables take the ways for tables of any size.
SMALL_LIMITS = SimilarityLimits(broadcast_rows=64, block_rows=128, max_cells=32)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _scratch(t: "Tables") -> str:
    """A folder of its own beside the checkpoints, for what a query writes and reads back."""
    return f"{ensure_checkpoint_dir(t.spark)}/query-{uuid.uuid4().hex}"


class Tables:
    """The given tables and those derived from them, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in _BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in SPARK_SQL:
            raise AttributeError(name)
        used = {t: getattr(self, t) for t in _BASE if t in SPARK_SQL[name]}
        # The texts name tables; Spark fills in the DataFrames.
        return self.spark.sql(_bind(SPARK_SQL[name], used), **used)

    @property
    def topics(self) -> DataFrame:
        return complete(self.memory_topics, "topics", AS_OF)

    @property
    def instances(self) -> DataFrame:
        return complete(self.memory_instances, "instances", AS_OF)

    @property
    def edges(self) -> DataFrame:
        return complete(self.topic_edges, "edges", AS_OF)

    @property
    def snapshot(self) -> Snapshot:
        return Snapshot(self.topics, self.instances, self.edges)


def _bind(sql: str, names) -> str:
    for name in names:
        sql = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", sql)
    return sql


def _query(name: str, oracle: str | None = None, needs: str = ""):
    """Register a query; ``needs`` names the derived tables of the oracle."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if oracle is not None:
            derived = ",\n".join(f"{t} as ({DUCKDB_SQL[t]})" for t in needs.split())
            body = oracle.strip()
            head = re.match(r"with(\s+recursive)?\s", body)
            if derived and head:
                body = f"{head[0].strip()} {derived},\n{body[head.end():]}"
            elif derived:
                body = f"with {derived}\n{body}"
            ORACLES[name] = body
        return build

    return register


def _six(name: str) -> Column:
    return F.round(name, 6).alias(name)


_TS = f"timestamp '{AS_OF}'"
_COS = "list_cosine_similarity"


# --- vector search -----------------------------------------------------------

_NEAREST = f"""
select query_id, topic_id, round(similarity, 6) as similarity, rank from (
  select query_id, t.id as topic_id, {_COS}(query_embedding::double[], topic_embedding) as similarity,
    row_number() over (partition by query_id
      order by round({_COS}(query_embedding::double[], topic_embedding), 12) desc, t.id) as rank
  from queries cross join memory_topics t) where rank <= {{k}}"""


@_query("j1_nearest_topic", _NEAREST.format(k=1), "queries memory_topics")
def _(t: Tables) -> DataFrame:
    found = search.nearest_topics(t.queries, t.topics, 1)
    return found.select("query_id", "topic_id", _six("similarity"), "rank")


@_query("j2_entry_points", _NEAREST.format(k=3), "queries memory_topics")
def _(t: Tables) -> DataFrame:
    found = search.nearest_topics(t.queries, t.topics, 3)
    return found.select("query_id", "topic_id", _six("similarity"), "rank")


@_query("j2_partitioned", _NEAREST.format(k=3), "queries memory_topics")
def _(t: Tables) -> DataFrame:
    found = search.nearest_topics(t.queries, t.topics, 3, SMALL_LIMITS)
    return found.select("query_id", "topic_id", _six("similarity"), "rank")


@_query("j3_top_instances", f"""
with near as (
  select query_id, query_embedding, topic_id from (
    select query_id, query_embedding, t.id as topic_id,
      row_number() over (partition by query_id
        order by round({_COS}(query_embedding::double[], topic_embedding), 12) desc, t.id) as rank
    from queries cross join memory_topics t) where rank <= 3)
select query_id, topic_id, instance_id, rank, round(score, 6) as instance_score from (
  select query_id, n.topic_id, i.id as instance_id,
    {_COS}(query_embedding::double[], content_embedding) * relevance_score * importance as score,
    row_number() over (partition by query_id, n.topic_id
      order by {_COS}(query_embedding::double[], content_embedding) * relevance_score * importance desc, i.id) as rank
  from near n join memory_instances i on i.topic_id = n.topic_id) where rank <= 10""",
        "queries memory_topics memory_instances")
def _(t: Tables) -> DataFrame:
    chosen = search.nearest_topics(t.queries, t.topics, 3).select("query_id", "topic_id")
    best = search.top_instances(chosen, t.queries, t.instances)
    return best.select("query_id", "topic_id", "instance_id", F.col("instance_rank").alias("rank"),
                       _six("instance_score"))


_PAIRS = f"""
select row_number() over (order by similarity desc, id1, id2) as rank, id1, id2, similarity from (
  select a.id as id1, b.id as id2, round({_COS}(a.topic_embedding, b.topic_embedding), 12) as similarity
  from memory_topics a join memory_topics b on a.id < b.id
  where {_COS}(a.topic_embedding, b.topic_embedding) > 0.85
  order by 3 desc, 1, 2 limit 10)"""


@_query("j4_similar_pairs", f"select rank, id1, id2, round(similarity, 6) as similarity from ({_PAIRS})",
        "memory_topics")
def _(t: Tables) -> DataFrame:
    return merge.similar_topics(t.topics).select("rank", "id1", "id2", _six("similarity"))


@_query("j4_partitioned", f"select rank, id1, id2, round(similarity, 6) as similarity from ({_PAIRS})",
        "memory_topics")
def _(t: Tables) -> DataFrame:
    return merge.similar_topics(t.topics, limits=SMALL_LIMITS).select("rank", "id1", "id2", _six("similarity"))


@_query("j2_cells_recall", "select count(*) as n_queries, true as finds_enough from queries", "queries")
def _(t: Tables) -> DataFrame:
    # Every query against the nearest cells of the stored topics; the exact search tells what was missed.
    place = f"{ensure_checkpoint_dir(t.spark)}/cells-{uuid.uuid4().hex}"
    points = cut_lineage(vb.side(t.topics, "id", "topic_embedding"))
    stored = approximate.store_cells(points, place)
    asked = vb.side(t.queries, "query_id", "query_embedding")
    found, measured = approximate.nearest_in_cells(stored, asked, 3)
    # Read twice below, and the search is not run twice.
    found = cut_lineage(found.select("l_id", "r_id"))
    recall = approximate.share_found(similarity.nearest(asked, points, 3), found, ["l_id", "r_id"])
    return found.agg(F.count_distinct("l_id").alias("n_queries"), F.lit(min(recall, measured) >= 0.9).alias("finds_enough"))


@_query("j4_hashed_recall", f"select count(*) as n_pairs, true as finds_enough from ({_PAIRS})", "memory_topics")
def _(t: Tables) -> DataFrame:
    points = cut_lineage(vb.side(t.topics, "id", "topic_embedding"))
    found = cut_lineage(approximate.similar_pairs_hashed(points, 0.85))
    recall = approximate.share_found(similarity.similar_pairs(points, 0.85), found, ["id1", "id2"])
    return found.agg(F.count(F.lit(1)).alias("n_pairs"), F.lit(recall >= 0.9).alias("finds_enough"))


@_query("j4_follow_best", f"""
select id1, id2, round(similarity, 6) as similarity from (
  select a.id as id1, b.id as id2, {_COS}(a.topic_embedding, b.topic_embedding) as similarity,
    row_number() over (partition by b.id
      order by round({_COS}(a.topic_embedding, b.topic_embedding), 12) desc, a.id) as rank
  from memory_topics a join memory_topics b on a.id < b.id
  where {_COS}(a.topic_embedding, b.topic_embedding) > 0.85) where rank = 1""", "memory_topics")
def _(t: Tables) -> DataFrame:
    from fadegraph.operators.similarity import nearest_lower

    best = nearest_lower(vb.side(t.topics, "id", "topic_embedding"), 0.85)
    return best.select("id1", "id2", _six("similarity"))


# Contents offered again: each document under its own topic and under the next.
_OFFERED = """
select topic_id, content, id as offer from memory_instances
union all
select concat('t', lpad(cast(cast(substr(topic_id, 2) as bigint) + 1 as {text}), 9, '0')), content, id
from memory_instances"""


@_query("j5_new_contents", f"""
with offered as ({_OFFERED.format(text='varchar')})
select topic_id, offer, md5(content) as content_digest from offered o
where not exists (select 1 from memory_instances i where i.topic_id = o.topic_id and i.content = o.content)""",
        "memory_instances")
def _(t: Tables) -> DataFrame:
    offered = t.spark.sql(_OFFERED.replace("memory_instances", "{memory_instances}").format(
        text="string", memory_instances="{memory_instances}"), memory_instances=t.memory_instances)
    fresh = ingest.new_contents(offered, t.instances)
    return fresh.select("topic_id", "offer", F.md5("content").alias("content_digest"))


@_query("j6_neighbors", """
select e.from_topic as topic_id, t.id as neighbor_id, t.topic_name as neighbor_name, e.weight as edge_weight
from topic_edges e join memory_topics t on e.to_topic = t.id where e.weight >= 0.3""", "topic_edges memory_topics")
def _(t: Tables) -> DataFrame:
    return graph.neighbors(t.edges, t.topics)


_DRAW = "cast(concat('0x', substr(md5(concat(from_topic, '|', to_topic, '|42')), 1, 8)) as ubigint) / 4294967296.0"


@_query("p20_dropout", f"""
select from_topic, to_topic, weight, round({_DRAW}, 6) as draw, weight < 0.5 and {_DRAW} < 0.3 as is_dropped
from topic_edges""", "topic_edges")
def _(t: Tables) -> DataFrame:
    draw = scoring.dropout_draw(F.col("from_topic"), F.col("to_topic"), 42)
    return t.edges.select("from_topic", "to_topic", "weight", F.round(draw, 6).alias("draw"),
                          scoring.is_dropped(F.col("weight"), draw, 0.3).alias("is_dropped"))


_FOLLOWED = f"""ranked as (
  select from_topic, to_topic, weight,
    row_number() over (partition by from_topic order by weight desc, to_topic) as edge_rank
  from topic_edges where weight >= 0.2),
followed as (select * from ranked where edge_rank <= 8 and not (weight < 0.5 and {_DRAW} < {{rate}}))"""


@_query("j10_ranked_edges", f"""
with ranked as (
  select from_topic, to_topic, weight,
    row_number() over (partition by from_topic order by weight desc, to_topic) as edge_rank
  from topic_edges where weight >= 0.2)
select *, weight < 0.5 and {_DRAW} < 0.3 as is_dropped from ranked where edge_rank <= 8""", "topic_edges")
def _(t: Tables) -> DataFrame:
    return graph.ranked_edges(t.edges, SearchConfig())


# --- search ------------------------------------------------------------------


def _search_oracle(rate: float, depth: int = 5) -> str:
    """The levels of the search written out one after the other."""
    parts = [_FOLLOWED.format(rate=rate), f"""l0 as (
  select query_id, topic_id, [rank] as path, similarity as path_strength from (
    select query_id, t.id as topic_id, {_COS}(query_embedding::double[], topic_embedding) as similarity,
      row_number() over (partition by query_id
        order by round({_COS}(query_embedding::double[], topic_embedding), 12) desc, t.id) as rank
    from queries cross join memory_topics t) where rank <= 3)"""]
    for level in range(1, depth + 1):
        seen = " union all ".join(f"select query_id, topic_id from l{i}" for i in range(level))
        parts.append(f"""s{level} as (
  select l.query_id, e.to_topic as topic_id, list_append(l.path, e.edge_rank) as path,
    l.path_strength * e.weight as path_strength
  from l{level - 1} l join followed e on e.from_topic = l.topic_id),
l{level} as (
  select query_id, topic_id, path, path_strength from (
    select *, row_number() over (partition by query_id, topic_id order by path) as arrival from s{level}) s
  where arrival = 1 and not exists (
    select 1 from ({seen}) v where v.query_id = s.query_id and v.topic_id = s.topic_id))""")
    every = " union all ".join(f"select *, {i} as depth from l{i}" for i in range(depth + 1))
    parts.append(f"visited as ({every})")
    parts.append(f"""scored as (
  select v.query_id, v.topic_id, t.topic_name, v.depth, v.path, v.path_strength,
    {_COS}(q.query_embedding::double[], t.topic_embedding) * t.strength * v.path_strength as score
  from visited v join memory_topics t on t.id = v.topic_id join queries q on q.query_id = v.query_id)""")
    return "with " + ",\n".join(parts)


_SEARCH_TABLES = "queries memory_topics topic_edges"


def _bfs_columns(scored: DataFrame) -> DataFrame:
    return scored.select("query_id", "topic_id", "depth", F.array_join("path", ".").alias("path"),
                         _six("path_strength"), _six("score"), "is_result")


_BFS_SELECT = """
select query_id, topic_id, depth, array_to_string(path, '.') as path, round(path_strength, 6) as path_strength,
  round(score, 6) as score, score > 0.25 as is_result from scored"""


@_query("g1_bfs", _search_oracle(0.3) + _BFS_SELECT, _SEARCH_TABLES)
def _(t: Tables) -> DataFrame:
    return _bfs_columns(search.search(t.queries, t.topics, t.edges)[0])


@_query("g1_bfs_no_dropout", _search_oracle(0.0) + _BFS_SELECT, _SEARCH_TABLES)
def _(t: Tables) -> DataFrame:
    return _bfs_columns(search.search(t.queries, t.topics, t.edges, SearchConfig(dropout_rate=0.0))[0])


_CHOSEN = """,
chosen as (
  select * from (select *, row_number() over (partition by query_id order by score desc, depth, path) as rank
  from scored where score > 0.25) where rank <= 5)"""


@_query("g2_read", _search_oracle(0.3) + _CHOSEN + f""",
best as (
  select c.query_id, c.rank, c.topic_id, c.topic_name, c.score, i.content,
    row_number() over (partition by c.query_id, c.topic_id order by
      {_COS}(q.query_embedding::double[], i.content_embedding) * i.relevance_score * i.importance desc, i.id) as n
  from chosen c join queries q on q.query_id = c.query_id join memory_instances i on i.topic_id = c.topic_id)
select query_id, row_number() over (partition by query_id order by rank) as rank, topic_id, topic_name,
  round(score, 6) as score, n_contents, contents from (
  select query_id, rank, topic_id, topic_name, score, count(*) as n_contents,
    md5(string_agg(content, '|' order by n)) as contents
  from best where n <= 10 group by all)""", _SEARCH_TABLES + " memory_instances")
def _(t: Tables) -> DataFrame:
    results = recall(t.snapshot, t.queries, as_of=AS_OF).results
    return results.select("query_id", "rank", "topic_id", "topic_name", _six("score"),
                          F.size("contents").alias("n_contents"),
                          F.md5(F.array_join("contents", "|")).alias("contents"))


@_query("u3_u4_reinforced_topics", _search_oracle(0.3) + _CHOSEN + f""",
visits as (select topic_id, count(*) as n from visited group by 1),
returns as (select topic_id, count(*) as n from chosen group by 1)
select t.id, round(least(t.strength + coalesce(v.n, 0) * 0.05 + coalesce(r.n, 0) * 0.1, 1.0), 6) as strength,
  t.access_count + coalesce(r.n, 0) as access_count,
  case when v.n is null then t.last_accessed else {_TS} end as last_accessed
from memory_topics t left join visits v on v.topic_id = t.id left join returns r on r.topic_id = t.id""",
        _SEARCH_TABLES)
def _(t: Tables) -> DataFrame:
    topics = recall(t.snapshot, t.queries, as_of=AS_OF).snapshot.topics
    return topics.select("id", _six("strength"), "access_count", "last_accessed")


@_query("u5_reinforced_edges", _search_oracle(0.3) + f""",
used as (
  select e.from_topic, e.to_topic, count(*) as n from visited v join followed e on e.from_topic = v.topic_id group by 1, 2)
select e.from_topic, e.to_topic, round(least(e.weight + coalesce(u.n, 0) * 0.02, 1.0), 6) as weight,
  case when u.n is null then e.last_activated else {_TS} end as last_activated
from topic_edges e left join used u on u.from_topic = e.from_topic and u.to_topic = e.to_topic""", _SEARCH_TABLES)
def _(t: Tables) -> DataFrame:
    edges = recall(t.snapshot, t.queries, as_of=AS_OF).snapshot.edges
    return edges.select("from_topic", "to_topic", _six("weight"), "last_activated")


# --- statistics and export ---------------------------------------------------

_ALL = "memory_topics memory_instances topic_edges"


@_query("a1_stats", """
select (select count(*) from memory_topics) as total_topics, (select count(*) from memory_instances) as total_instances,
  (select count(*) from topic_edges) as total_edges,
  (select round(avg(strength), 6) from memory_topics) as avg_topic_strength,
  (select round(avg(weight), 6) from topic_edges) as avg_edge_weight,
  (select count(*) from memory_topics where strength > 0.5) as strong_topics,
  (select count(*) from memory_topics where strength < 0.2) as weak_topics""", _ALL)
def _(t: Tables) -> DataFrame:
    return graph.stats(t.snapshot).withColumns({
        "avg_topic_strength": F.round("avg_topic_strength", 6), "avg_edge_weight": F.round("avg_edge_weight", 6)})


_UNLINKED = "id not in (select from_topic from topic_edges) and id not in (select to_topic from topic_edges)"


@_query("g4_orphans", f"select id, topic_name, strength from memory_topics where {_UNLINKED} and strength < 0.3",
        "memory_topics topic_edges")
def _(t: Tables) -> DataFrame:
    return graph.orphans(t.topics, t.edges)


@_query("j7_unlinked", f"select id, strength from memory_topics where {_UNLINKED}", "memory_topics topic_edges")
def _(t: Tables) -> DataFrame:
    return graph.unlinked(t.topics, t.edges).select("id", "strength")


@_query("j9_instance_counts", "select topic_id, count(*) as instance_count from memory_instances group by 1",
        "memory_instances")
def _(t: Tables) -> DataFrame:
    return graph.instance_counts(t.instances)


@_query("g5_nodes", """
select id, topic_name as label, strength, access_count,
  (select count(*) from memory_instances i where i.topic_id = t.id) as instance_count,
  round(strength * (1 + ln(1 + access_count)), 6) as size from memory_topics t""", "memory_topics memory_instances")
def _(t: Tables) -> DataFrame:
    return graph.export_nodes(t.topics, t.instances).withColumn("size", F.round("size", 6))


@_query("g5_edges", """
select from_topic as source, to_topic as target, weight, activation_count from topic_edges where weight > 0.2""",
        "topic_edges")
def _(t: Tables) -> DataFrame:
    return graph.export_edges(t.edges)


@_query("g5_stats", """
select (select count(distinct id) from memory_topics) as total_topics,
  (select count(*) from memory_instances) as total_instances,
  (select count(*) from topic_edges where weight > 0.2) as total_edges,
  (select round(coalesce(avg(strength), 0), 6) from memory_topics) as avg_topic_strength""", _ALL)
def _(t: Tables) -> DataFrame:
    return graph.export_stats(t.snapshot).withColumn("avg_topic_strength", F.round("avg_topic_strength", 6))


@_query("constraints", """
select 'topics_range' as check, (select count(*) from memory_topics where strength not between 0 and 1) as n_rows
union all select 'instances_range', (select count(*) from memory_instances
  where relevance_score not between 0 and 1 or importance not between 0 and 1)
union all select 'edges_range', (select count(*) from topic_edges where weight not between 0 and 1)
union all select 'topics_key', (select count(*) - count(distinct id) from memory_topics)
union all select 'instances_key', (select count(*) - count(distinct id) from memory_instances)
union all select 'edges_key', (select count(*) - count(distinct (from_topic, to_topic)) from topic_edges)
union all select 'dangling', (select count(*) from memory_instances where topic_id not in (select id from memory_topics))""",
        _ALL)
def _(t: Tables) -> DataFrame:
    return violations(t.snapshot)


# --- forgetting --------------------------------------------------------------

_DAYS = f"(epoch_us({_TS}) - epoch_us({{ts}})) / 86400000000.0"
_TOPIC_DAYS = _DAYS.format(ts="last_accessed")
_DECAYED = f"strength * pow(0.5, {_TOPIC_DAYS} / half_life_days)"


@_query("u6_decay_topics", f"""
select id, round(greatest({_DECAYED}, 0.01), 6) as strength, round({_DECAYED}, 6) as decayed_strength
from memory_topics""", "memory_topics")
def _(t: Tables) -> DataFrame:
    return updates.decay_topics(t.topics, AS_OF).select("id", _six("strength"), _six("decayed_strength"))


@_query("u7_decay_edges", f"""
select from_topic, to_topic, last_activated < {_TS} - interval '1 day' as is_decayed,
  round(case when last_activated < {_TS} - interval '1 day'
    then greatest(weight * pow(0.5, {_DAYS.format(ts='last_activated')} / 7.0), 0.01) else weight end, 6) as weight
from topic_edges""", "topic_edges")
def _(t: Tables) -> DataFrame:
    return updates.decay_idle_edges(t.edges, AS_OF).select("from_topic", "to_topic", "is_decayed", _six("weight"))


@_query("a11_decayed_edge_count", f"""
select count(*) as n_decayed from topic_edges where last_activated < {_TS} - interval '1 day'""", "topic_edges")
def _(t: Tables) -> DataFrame:
    return updates.decay_idle_edges(t.edges, AS_OF).agg(F.count_if("is_decayed").alias("n_decayed"))


@_query("a11_counted_in_write", f"""
select (select count(*) from topic_edges where last_activated < {_TS} - interval '1 day') as n_decayed,
  (select count(*) from topic_edges where weight < 0.05) as n_pruned,
  (select count(*) from memory_topics where greatest({_DECAYED}, 0.01) < 0.05
    and last_accessed < {_TS} - interval '30 days' and access_count < 5) as n_evicted""", "topic_edges memory_topics")
def _(t: Tables) -> DataFrame:
    # Each number comes with the write of the changed table.
    evicted, topics = updates.evict_counted(t.snapshot, as_of=AS_OF)
    counted = {"n_decayed": updates.decay_idle_edges_counted(t.edges, AS_OF), "n_pruned": updates.prune_edges_counted(t.edges), "n_evicted": topics}
    place = _scratch(t)
    for name, changed in counted.items():
        (evicted.topics if name == "n_evicted" else changed.rows).write.parquet(f"{place}/{name}")
    return t.spark.createDataFrame([tuple(c.n_affected for c in counted.values())], ", ".join(f"{n} long" for n in counted))


def _registered(t: Tables) -> str:
    prefix = f"m{uuid.uuid4().hex[:8]}"
    sql.register(t.spark, t.snapshot, prefix)
    return prefix


@_query("f3_neighbors_in_sql", """
select q.id as asked, n.id as neighbor_id, n.topic_name as neighbor_name, e.weight as edge_weight
from memory_topics q join topic_edges e on e.from_topic = q.id join memory_topics n on e.to_topic = n.id
where q.strength > 0.5 and e.weight >= 0.4""", "topic_edges memory_topics")
def _(t: Tables) -> DataFrame:
    m = _registered(t)
    return t.spark.sql(f"""select q.id as asked, n.neighbor_id, n.neighbor_name, n.edge_weight
        from {m}_topics q, lateral {m}_topic_neighbors(q.id, 0.4D) n where q.strength > 0.5""")


@_query("f3_orphans_in_sql", f"select id, topic_name, strength from memory_topics where {_UNLINKED} and strength < 0.3", "memory_topics topic_edges")
def _(t: Tables) -> DataFrame:
    return t.spark.sql(f"select * from {_registered(t)}_orphan_topics()")


@_query("f4_decay_in_sql", f"""
select id, round(greatest({_DECAYED}, 0.01), 6) as strength, round({_DECAYED}, 6) as decayed_strength,
  round(least(strength + 0.1, 1.0), 6) as boosted from memory_topics""", "memory_topics")
def _(t: Tables) -> DataFrame:
    m = _registered(t)
    return t.spark.sql(f"""select d.id, round(d.strength, 6) as strength, round(d.decayed_strength, 6) as decayed_strength,
        round({m}_clamp_add(t.strength, 0.1D), 6) as boosted
        from {m}_decayed_topics(timestamp_ntz'{AS_OF}') d join {m}_topics t on t.id = d.id""")


@_query("f4_weak_in_sql", f"""
select id from memory_topics where greatest({_DECAYED}, 0.01) < 0.05 and last_accessed < {_TS} - interval '30 days' and access_count < 5""",
        "memory_topics")
def _(t: Tables) -> DataFrame:
    return t.spark.sql(f"select id from {_registered(t)}_weak_topics(timestamp_ntz'{AS_OF}')")


@_query("t4_access_fold", """
select t.id, round(least(strength + coalesce(n, 0) * 0.1, 1.0), 6) as strength,
  access_count + coalesce(n, 0) as access_count,
  case when n is null then last_accessed else greatest(last_accessed, last) end as last_accessed,
  round(ln(half_life_days) + coalesce(n, 0) * ln(1.1), 6) as log_half_life
from memory_topics t left join (
  select topic_id, count(*) as n, max(ts) as last from access_log group by 1) a on a.topic_id = t.id""",
        "memory_topics access_log")
def _(t: Tables) -> DataFrame:
    # The half-life of a busy topic outgrows a comparison by digits; its logarithm does not.
    folded = updates.strengthen_topics(t.topics, updates.count_accesses(t.access_log), as_of=AS_OF)
    return folded.select("id", _six("strength"), "access_count", "last_accessed",
                         F.round(F.log("half_life_days"), 6).alias("log_half_life"))


@_query("u8_strengthen", f"""
select id, round(least(strength + 0.1, 1.0), 6) as strength, access_count + 1 as access_count,
  {_TS} as last_accessed, round(half_life_days * 1.1, 6) as half_life_days from memory_topics""", "memory_topics")
def _(t: Tables) -> DataFrame:
    once = t.topics.select(F.col("id").alias("topic_id"), F.lit(1).alias("n_accesses"),
                           clock(AS_OF).alias("last_access"))
    return updates.strengthen_topics(t.topics, once, as_of=AS_OF).select(
        "id", _six("strength"), "access_count", "last_accessed", _six("half_life_days"))


_WEAK = f"""
weak as (select id from memory_topics where greatest({_DECAYED}, 0.01) < 0.05
  and last_accessed < {_TS} - interval '30 days' and access_count < 5)"""


@_query("u9_evict", f"""
with {_WEAK}
select 'topics' as kind, (select count(*) from memory_topics where id not in (select id from weak)) as n_left,
  (select count(*) from weak) as n_removed
union all select 'instances', (select count(*) from memory_instances where topic_id not in (select id from weak)),
  (select count(*) from memory_instances where topic_id in (select id from weak))
union all select 'edges',
  (select count(*) from topic_edges where from_topic not in (select id from weak) and to_topic not in (select id from weak)),
  (select count(*) from topic_edges where from_topic in (select id from weak) or to_topic in (select id from weak))""", _ALL)
def _(t: Tables) -> DataFrame:
    before = t.snapshot
    after, _ = updates.evict(before, as_of=AS_OF)
    parts = []
    for kind in ("topics", "instances", "edges"):
        old = getattr(before, kind).select(F.lit(kind).alias("kind"), F.lit(0).alias("is_left"))
        new = getattr(after, kind).select(F.lit(kind).alias("kind"), F.lit(1).alias("is_left"))
        parts.append(old.unionByName(new).groupBy("kind").agg(
            F.sum("is_left").alias("n_left"), (F.count(F.lit(1)) - 2 * F.sum("is_left")).alias("n_removed")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("u9_evicted_topics", f"with {_WEAK} select id from weak", "memory_topics")
def _(t: Tables) -> DataFrame:
    return updates.evict(t.snapshot, as_of=AS_OF)[1].select("id")


@_query("u10_importance", f"""
select i.id, round(0.3
  * exp(-(extract(day from {_TS} - i.last_accessed)) / 30.0) + 0.4 * relevance_score
  + 0.3 * least((1 - {_COS}(i.content_embedding, t.topic_embedding)) * 1.5, 1.0), 6) as importance
from memory_instances i join memory_topics t on t.id = i.topic_id""", "memory_instances memory_topics")
def _(t: Tables) -> DataFrame:
    return updates.rescore_importance(t.instances, t.topics, AS_OF).select("id", _six("importance"))


@_query("u11_fade_edges", """
select from_topic, to_topic, round(case when weight > 0.1 then weight * 0.95 else weight end, 6) as weight
from topic_edges""", "topic_edges")
def _(t: Tables) -> DataFrame:
    return updates.fade_edges(t.edges).select("from_topic", "to_topic", _six("weight"))


@_query("u12_prune_edges", "select from_topic, to_topic, weight from topic_edges where not weight < 0.05",
        "topic_edges")
def _(t: Tables) -> DataFrame:
    return updates.prune_edges(t.edges).select("from_topic", "to_topic", "weight")


@_query("u15_orphans", f"""
select id from memory_topics where not ({_UNLINKED} and strength < 0.1 and access_count < 2)""",
        "memory_topics topic_edges")
def _(t: Tables) -> DataFrame:
    gone = graph.forgotten_orphans(t.topics, t.edges)
    return updates.cascade(t.snapshot, gone).topics.select("id")


@_query("u17_touch_topics", """
select t.id, greatest(t.last_accessed, coalesce(m.latest, t.last_accessed)) as last_accessed
from memory_topics t left join (
  select topic_id, max(last_accessed) as latest from memory_instances group by 1) m on m.topic_id = t.id""",
        "memory_topics memory_instances")
def _(t: Tables) -> DataFrame:
    return updates.touch_topics(t.topics, t.instances).select("id", "last_accessed")


# --- scores on joined rows ---------------------------------------------------

_HOMES = """
from memory_instances i join memory_topics t on t.id = i.topic_id"""


def _homes(t: Tables) -> DataFrame:
    topics = t.topics.select(F.col("id").alias("home"), "topic_embedding")
    return t.instances.join(topics, F.col("topic_id") == F.col("home"))


@_query("p1_cosine", f"select i.id, round({_COS}(topic_embedding, content_embedding), 6) as similarity {_HOMES}",
        "memory_instances memory_topics")
def _(t: Tables) -> DataFrame:
    similarity = vectors.cosine_similarity(F.col("topic_embedding"), F.col("content_embedding"))
    return _homes(t).select("id", F.round(similarity, 6).alias("similarity"))


@_query("p2_relevance", f"""
select i.id, round(greatest(0, 1 - list_distance(topic_embedding, content_embedding) / 2), 6) as relevance {_HOMES}""",
        "memory_instances memory_topics")
def _(t: Tables) -> DataFrame:
    score = vectors.relevance(F.col("topic_embedding"), F.col("content_embedding"))
    return _homes(t).select("id", F.round(score, 6).alias("relevance"))


@_query("p3_guarded_cosine", f"""
select i.id, round(case when i.relevance_score = 0 then 0
  else {_COS}(topic_embedding, content_embedding) end, 6) as similarity {_HOMES}""",
        "memory_instances memory_topics")
def _(t: Tables) -> DataFrame:
    # Instances of no relevance get a vector of zeros, which has no direction.
    vector = F.transform("content_embedding", lambda v: F.when(F.col("relevance_score") == 0, 0.0).otherwise(v))
    similarity = vectors.cosine_or_zero(F.col("topic_embedding"), vector)
    return _homes(t).select("id", F.round(similarity, 6).alias("similarity"))


@_query("p4_l2_topk", """
select topic_id, instance_id, rank, round(distance, 6) as distance from (
  select i.topic_id, i.id as instance_id, list_distance(topic_embedding, content_embedding) as distance,
    row_number() over (partition by i.topic_id
      order by list_distance(topic_embedding, content_embedding), i.id) as rank
  from memory_instances i join memory_topics t on t.id = i.topic_id) where rank <= 10""",
        "memory_instances memory_topics")
def _(t: Tables) -> DataFrame:
    gap = vectors.l2_distance(F.col("topic_embedding"), F.col("content_embedding"))
    near = _homes(t).select("topic_id", F.col("id").alias("instance_id"), gap.alias("distance"))
    order = Window.partitionBy("topic_id").orderBy("distance", "instance_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 10).withColumn(
        "distance", F.round("distance", 6))


@_query("p8_days", f"""
select id, extract(day from {_TS} - last_accessed) as whole_days, round({_TOPIC_DAYS}, 6) as days
from memory_instances""", "memory_instances")
def _(t: Tables) -> DataFrame:
    now = clock(AS_OF)
    days = scoring.elapsed_days(F.col("last_accessed"), now)
    return t.instances.select("id", scoring.whole_days(F.col("last_accessed"), now).alias("whole_days"),
                              F.round(days, 6).alias("days"))


# --- triples -----------------------------------------------------------------

_TRIPLES = "triples"


@_query("a2_by_subject", """
select source_file, subject as topic, triple_ord as ord, concat(relation, ' ', object) as instance from triples""", _TRIPLES)
def _(t: Tables) -> DataFrame:
    return aggregate.convert(t.triples, "subject")


@_query("a3_by_relation", """
select source_file, relation as topic, triple_ord as ord, concat(subject, ' ', relation, ' ', object) as instance
from triples""", _TRIPLES)
def _(t: Tables) -> DataFrame:
    return aggregate.convert(t.triples, "relation")


@_query("a4_hybrid", """
with counted as (
  select *, count(*) over (partition by source_file, subject) as n_s,
    count(*) over (partition by source_file, relation) as n_r from triples),
filed as (
  select source_file, case when n_s >= 3 then subject when n_r >= 3 then relation end as topic, triple_ord as ord,
    case when n_s >= 3 then concat(relation, ' ', object) else concat(subject, ' ', relation, ' ', object) end as instance
  from counted),
sized as (select *, count(*) over (partition by source_file, topic) as n from filed where topic is not null)
select source_file, topic, ord, instance from sized where n >= 3""", _TRIPLES)
def _(t: Tables) -> DataFrame:
    return aggregate.convert(t.triples, "hybrid", min_instances=3)


@_query("a5_entity", """
select source_file, subject as topic, triple_ord * 2 as ord, concat(relation, ' ', object) as instance from triples
union all select source_file, object, triple_ord * 2 + 1, concat(subject, ' ', relation) from triples""", _TRIPLES)
def _(t: Tables) -> DataFrame:
    return aggregate.convert(t.triples, "entity")


@_query("a13_frequencies", """
select 'subject' as role, source_file, subject as value, count(*) as n_triples from triples group by all
union all select 'relation', source_file, relation, count(*) from triples group by all""", _TRIPLES)
def _(t: Tables) -> DataFrame:
    counted = [
        aggregate.frequencies(t.triples, c).select(
            F.lit(c).alias("role"), "source_file", F.col(c).alias("value"), "n_triples")
        for c in ("subject", "relation")]
    return counted[0].unionByName(counted[1])


@_query("a2_topic_sizes", """
select source_file, subject as topic, count(*) as n_instances, min(triple_ord) as first_ord from triples group by 1, 2""",
        _TRIPLES)
def _(t: Tables) -> DataFrame:
    return aggregate.topic_sizes(aggregate.by_subject(t.triples))


@_query("a14_topic_arrays", """
select source_file, topic, chunk, first_ord, len(list) as n_instances, array_to_string(list, '|') as instances from (
  select source_file, object as topic, triple_ord // 100 as chunk, min(triple_ord) as first_ord,
    list(concat(subject, ' ', relation) order by triple_ord) as list from triples group by 1, 2, 3)""", _TRIPLES)
def _(t: Tables) -> DataFrame:
    rows = t.triples.select("source_file", F.col("object").alias("topic"), F.col("triple_ord").alias("ord"),
                            F.concat_ws(" ", "subject", "relation").alias("instance"))
    return aggregate.topic_arrays(rows, 100).select(
        "source_file", "topic", "chunk", "first_ord", F.size("instances").alias("n_instances"),
        F.array_join("instances", "|").alias("instances"))


_SPREAD = "sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2)"


def _lloyd(steps: int, k: int) -> str:
    """KMeans by file on the sizes of the parts of triples, step by step."""
    text_ = f"""
with points as (
  select *, concat(subject, ' ', relation, ' ', object) as instance, cast(length(subject) as double) as x,
    cast(length(relation) as double) as y, 2.0 * length(object) as z from triples),
different as (select source_file, x, y, z, min(triple_ord) as ord from points group by 1, 2, 3, 4),
c0 as (
  select * from (select source_file, row_number() over (partition by source_file order by ord) as cluster, x, y, z from different)
  where cluster <= {k})"""
    for step in range(steps + 1):
        text_ += f""",
a{step} as (
  select p.*, c.cluster, round({_SPREAD}, 12) as gap from points p join c{step} c using (source_file)
  qualify row_number() over (partition by p.source_file, p.triple_ord order by round({_SPREAD}, 12), c.cluster) = 1),
c{step + 1} as (select source_file, cluster, avg(x) as x, avg(y) as y, avg(z) as z from a{step} group by 1, 2)"""
    return text_ + f"""
select source_file, topic, count(*) as n_instances, min(instance) as first_instance from (
  select source_file, instance, first_value(subject) over (partition by source_file, cluster order by gap, triple_ord) as topic
  from a{steps}) group by 1, 2"""


@_query("a6_kmeans", _lloyd(2, 3), _TRIPLES)
def _(t: Tables) -> DataFrame:
    class Sizes:
        @staticmethod
        def add(df: DataFrame, _: str) -> DataFrame:
            size = [F.length(c).cast("double") for c in ("subject", "relation", "object")]
            return df.withColumn("embedding", F.array(size[0], size[1], 2.0 * size[2]))

    return clusters.kmeans_topics(t.triples, Sizes, n_clusters=3, max_iter=2).groupBy("source_file", "topic").agg(
        F.count(F.lit(1)).alias("n_instances"), F.min("instance").alias("first_instance"))


def _vector_lloyd(steps: int, k: int) -> str:
    """KMeans by file on whole vectors, step by step."""
    sql = f"""
with points as (select label % 3 as source_file, vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
c0 as (
  select * from (select source_file, row_number() over (partition by source_file order by vec_id) as cluster, v as centre
    from (select source_file, v, min(vec_id) as vec_id from points group by 1, 2)) where cluster <= {k})"""
    for step in range(steps + 1):
        sql += f""",
a{step} as materialized (
  select source_file, vec_id, v, cluster, round(list_distance(v, centre), 12) as gap from points join c{step} using (source_file)
  qualify row_number() over (partition by source_file, vec_id order by round(list_distance(v, centre), 12), cluster) = 1),
c{step + 1} as (
  select source_file, cluster, list(x order by place) as centre from (
    select source_file, cluster, place, avg(x) as x from (
      select source_file, cluster, unnest(v) as x, generate_subscripts(v, 1) as place from a{step}) group by 1, 2, 3) group by 1, 2)"""
    return sql + f"""
select cast(source_file as varchar) as source_file, vec_id as ord,
  'v' || cast(first_value(vec_id) over (partition by source_file, cluster order by gap, vec_id) as varchar) as topic from a{steps}"""


@_query("a6_kmeans_vectors", _vector_lloyd(3, 6))
def _(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("triple_ord"), "embedding")

    class Given:
        @staticmethod
        def add(df: DataFrame, _: str) -> DataFrame:
            return df.join(vectors, "triple_ord")

    triples = t.embeddings.select(
        (F.col("label") % 3).cast("string").alias("source_file"), F.col("vec_id").alias("triple_ord"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("subject"), F.lit("is").alias("relation"), F.lit("given").alias("object"))
    return clusters.kmeans_topics(triples, Given, n_clusters=6, max_iter=3).select("source_file", "ord", "topic")


# Every customer is a file of two triples, in one of the layouts by its segment.
def _triple_files(t: Tables) -> DataFrame:
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = t.customer.join(nations, "c_nationkey")
    fields = {
        "AUTOMOBILE": ("subject", "relation", "object"),
        "BUILDING": ("arg1", "rel", "arg2"),
        "FURNITURE": ("subject", "predicate", "object"),
        "HOUSEHOLD": ("arg1", "predicate", "object"),
    }

    def pair(names: tuple[str, str, str]) -> Column:
        def one(relation: str, end: Column) -> Column:
            return F.struct(F.concat(F.lit("\n "), "c_name", F.lit(" ")).alias(names[0]),
                            F.lit(relation).alias(names[1]), end.alias(names[2]))

        return F.array(one("in segment", F.col("c_mktsegment")), one("lives in", F.col("n_name")))

    generic = F.to_json(F.struct(pair(("subject", "rel", "arg2")).alias("extractions")))
    text_ = F.when(
        F.col("c_mktsegment") == "AUTOMOBILE",
        F.to_json(F.struct(F.array(F.struct(pair(fields["AUTOMOBILE"]).alias("triples"))).alias("sentences"))),
    ).when(F.col("c_mktsegment") == "BUILDING", F.to_json(pair(fields["BUILDING"]))
           ).when(F.col("c_mktsegment") == "FURNITURE", F.to_json(pair(fields["FURNITURE"]))
                  ).when(F.col("c_mktsegment") == "HOUSEHOLD",
                         F.to_json(F.struct(pair(fields["HOUSEHOLD"]).alias("triples")))).otherwise(generic)
    return rows.select(F.col("c_name").alias("source_file"), text_.alias("text"))


@_query("r4_layouts", """
select case c_mktsegment when 'AUTOMOBILE' then 'stanford' when 'BUILDING' then 'allennlp'
  when 'FURNITURE' then 'clausie' else 'generic' end as layout, count(*) as n_files from customer group by 1""")
def _(t: Tables) -> DataFrame:
    return _triple_files(t).groupBy(openie.layout(F.col("text")).alias("layout")).agg(
        F.count(F.lit(1)).alias("n_files"))


@_query("r5_triples", """
select c_name as source_file, 0 as triple_ord, c_name as subject, 'in segment' as relation, c_mktsegment as object
from customer
union all select c_name, 1, c_name, 'lives in', n_name from customer join nation on c_nationkey = n_nationkey""")
def _(t: Tables) -> DataFrame:
    return openie.triples(_triple_files(t))


# Every customer is a file with a bad item between two good ones; every fifth is cut off, every seventh is plain text.
@_query("r5_quarantine", """
with kinds as (select *, case when c_custkey % 7 = 0 then 'plain' when c_custkey % 5 = 0 then 'cut' else 'bad' end as kind from customer)
select c_name as source_file, cast(1 as bigint) as place, 'not an object' as said from kinds where kind = 'bad'
union all select c_name, null, 'unknown layout' from kinds where kind = 'cut'
union all select c_name, null, 'unknown layout' from kinds where kind = 'plain'
union all select c_name, 0, c_mktsegment from kinds where kind = 'bad'
union all select c_name, 2, cast(c_nationkey as varchar) from kinds where kind = 'bad'""")
def _(t: Tables) -> DataFrame:
    def one(end: str) -> Column:
        return F.to_json(F.struct(F.col("c_name").alias("arg1"), F.lit("has").alias("rel"), F.col(end).cast("string").alias("arg2")))

    whole = F.concat(F.lit("["), one("c_mktsegment"), F.lit(',"oops",'), one("c_nationkey"), F.lit("]"))
    cut = F.concat(F.lit("["), one("c_mktsegment"), F.lit(', {"arg1'))
    body = F.when(F.col("c_custkey") % 7 == 0, F.lit("plain")).when(
        F.col("c_custkey") % 5 == 0, cut).otherwise(whole)
    files = t.customer.select(F.col("c_name").alias("source_file"), body.alias("text"))
    good = openie.triples(files).select("source_file", F.col("triple_ord").alias("place"), F.col("object").alias("said"))
    return good.unionByName(openie.quarantine(files).toDF("source_file", "place", "said"))


@_query("r12_record_texts", """
select cast(conv_id as varchar) as source_file, role, count(*) as n_texts, sum(length(text)) as n_chars,
  md5(string_agg(md5(text), '' order by md5(text))) as texts_digest
from conversations where text <> '' group by 1, 2""")
def _(t: Tables) -> DataFrame:
    # Each turn is a file of one record; the role decides the field that holds the text.
    record = F.when(F.col("role") == "user", F.to_json(F.array(F.struct(F.col("text").alias("sentence"))))).when(
        F.col("role") == "assistant", F.to_json(F.array(F.struct(F.lit("").alias("sentence"), "text")))).otherwise(
        F.to_json(F.array(F.array("text"))))
    files = t.conversations.select(F.concat_ws("|", "conv_id", "role", "turn").alias("source_file"),
                                   record.alias("text"))
    parts = F.split("source_file", r"\|")
    return openie.record_texts(files).filter(F.col("text") != "").groupBy(
        parts[0].alias("source_file"), parts[1].alias("role")).agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("n_chars"),
        F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("text"))), "")).alias("texts_digest"))


# A folder with one triple file for each nation, and files of another kind.
@_query("r2_scan_by_suffix", """
select row_number() over (partition by s_nationkey order by s_suppkey) - 1 as triple_ord, s_name as subject,
  'located in' as relation, n_name as object, dense_rank() over (order by n_nationkey) as file_no
from supplier join nation on s_nationkey = n_nationkey""")
def _(t: Tables) -> DataFrame:
    folder = f"{_scratch(t)}/files"
    item = F.struct(F.col("s_suppkey"), F.struct(F.col("s_name").alias("arg1"), F.lit("located in").alias("rel"), F.col("n_name").alias("arg2")).alias("item"))
    listed = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda p: p["item"])).alias("value"))
    # Rows in order, one in a file; names follow the order.
    texts = listed.coalesce(1).sortWithinPartitions("n_nationkey").select("value")
    texts.write.option("maxRecordsPerFile", 1).text(folder)
    t.region.select(F.lit("not triples").alias("arg1")).write.mode("append").json(folder)
    found = openie.read_triples(t.spark, folder, ".txt")
    order = found.groupBy("source_file").agg(F.count(F.lit(1))).select(
        "source_file", F.row_number().over(Window.orderBy("source_file")).alias("file_no"))
    return found.join(order, "source_file").select("triple_ord", "subject", "relation", "object", "file_no")


# Files of the orders of 4,000 keys, by turns lists and sentences; texts hold quotes, commas and brackets.
@_query("r5_split_triples", """
with dealt as (select *, o_orderkey // 4000 as file_no, concat('order, ', o_orderkey) as name from orders),
placed as (select *, row_number() over (partition by file_no order by o_orderkey) - 1 as nth from dealt)
select file_no, case when file_no % 2 = 0 then nth else 2 * nth end as triple_ord, name as subject, 'has "priority"' as relation,
  concat(o_orderpriority, ' [', o_orderstatus, '}, {') as object from placed
union all select file_no, 2 * nth + 1, name, 'dates\\from', cast(cast(o_orderdate as date) as varchar) from placed where file_no % 2 = 1""")
def _(t: Tables) -> DataFrame:
    folder = f"{_scratch(t)}/large"
    name = F.concat(F.lit("order, "), F.col("o_orderkey").cast("string"))
    rows = t.orders.withColumn("file_no", F.floor(F.col("o_orderkey") / 4000))

    def one(names: tuple[str, str, str], relation: str, end: Column) -> Column:
        return F.struct(name.alias(names[0]), F.lit(relation).alias(names[1]), end.alias(names[2]))

    priority = F.concat("o_orderpriority", F.lit(" ["), "o_orderstatus", F.lit("}, {"))
    said = 'has "priority"', priority
    plain = F.to_json(one(("arg1", "rel", "arg2"), *said))
    stanford = ("subject", "relation", "object")
    sentence = F.to_json(F.struct(F.array(
        one(stanford, *said), one(stanford, "dates\\from", F.col("o_orderdate").cast("date").cast("string"))).alias("triples")))
    is_list = F.col("file_no") % 2 == 0
    items = rows.select("file_no", F.col("o_orderkey").alias("at"), F.when(is_list, plain).otherwise(sentence).alias("value"))
    # Every item but the first has a comma in front; brackets stand around all.
    ends = items.groupBy("file_no").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    lines = items.join(ends, "file_no").select("file_no", "at", F.concat(
        F.when(F.col("at") > F.col("low"), ",").when(is_list, "[").otherwise('{"sentences": ['), "value",
        F.when(F.col("at") < F.col("high"), "").when(is_list, "]").otherwise("]}")).alias("value"))
    lines.repartition("file_no").sortWithinPartitions("file_no", "at").drop("at").write.partitionBy("file_no").text(folder)
    found, _ = openie.split_triples_and_quarantine(t.spark, f"{folder}/*", ".txt", chunk_bytes=1 << 16)
    return found.select(F.regexp_extract("source_file", r"file_no=(\d+)", 1).cast("long").alias("file_no"),
                        "triple_ord", "subject", "relation", "object")


# --- topic maps and tables ---------------------------------------------------


def _conversation_maps(t: Tables) -> DataFrame:
    """One topic-map file per conversation: its turns in order, and its roles as a plain text."""
    turns = t.conversations.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"]).alias("texts"),
        F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"))
    good = F.to_json(F.map_from_arrays(F.array(name), F.array("texts")))
    body = F.concat(F.substring(good, 1, F.length(good) - 1), F.lit(',"turns":"'), F.col("n").cast("string"), F.lit('"}'))
    return turns.select(name.alias("source_file"), body.alias("text"))


@_query("r1_topic_map", """
select concat('conv_', cast(conv_id as varchar)) as source_file, concat('conv_', cast(conv_id as varchar)) as topic,
  row_number() over (partition by conv_id order by turn, text) - 1 as ord, md5(text) as instance
from conversations""")
def _(t: Tables) -> DataFrame:
    entries, _ = topic_map.parse_topic_map(_conversation_maps(t))
    return topic_map.topic_map_rows(entries).select("source_file", "topic", "ord", F.md5("instance").alias("instance"))


# A file for each nation: its customers with two texts each, then a list of none and a plain text.
@_query("r1_split_topic_map", """
with placed as (select *, row_number() over (partition by c_nationkey order by c_custkey) - 1 as nth from customer)
select c_nationkey as file_no, c_name as topic, nth * 2147483648 as ord, concat(c_mktsegment, ', "', c_nationkey, '"') as instance from placed
union all select c_nationkey, c_name, nth * 2147483648 + 1, '] , \\}' from placed
union all select c_nationkey, 'about', count(*), 'x, y' from customer group by 1""")
def _(t: Tables) -> DataFrame:
    folder = f"{_scratch(t)}/maps"
    texts = F.array(F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')), F.lit("] , \\}"))
    member = F.to_json(F.map_from_arrays(F.array("c_name"), F.array(texts)))
    ends = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))
    lines = t.customer.join(ends, "c_nationkey").select(
        F.col("c_nationkey").alias("file_no"), F.col("c_custkey").alias("at"), F.concat(
            F.when(F.col("c_custkey") > F.col("low"), ",").otherwise("{"), F.substring(member, F.lit(2), F.length(member) - 2),
            F.when(F.col("c_custkey") < F.col("high"), "").otherwise(', "about": "x, y", "none": []}')).alias("value"))
    lines.repartition("file_no").sortWithinPartitions("file_no", "at").drop("at").write.partitionBy("file_no").text(folder)
    rows, quarantine = topic_map.split_topic_map(t.spark, f"{folder}/*", ".txt", chunk_bytes=1 << 12)
    found = rows.unionByName(quarantine.select("source_file", "topic", F.col("entry_ord").alias("ord"), F.col("value").alias("instance")))
    return found.select(F.regexp_extract("source_file", r"file_no=(\d+)", 1).cast("long").alias("file_no"), "topic", "ord", "instance")


@_query("r1_quarantine", """
select concat('conv_', cast(conv_id as varchar)) as source_file, 'turns' as topic, cast(count(*) as varchar) as value
from conversations group by 1""")
def _(t: Tables) -> DataFrame:
    return topic_map.parse_topic_map(_conversation_maps(t))[1].select("source_file", "topic", "value")


@_query("r10_positions", """
select topic, value, ord from (
  select concat('conv_', cast(conv_id as varchar)) as topic, md5(text) as value,
    row_number() over (partition by conv_id order by turn, text) as ord from conversations)""")
def _(t: Tables) -> DataFrame:
    entries, _ = topic_map.parse_topic_map(_conversation_maps(t))
    rows = tables.with_position(entries.select("topic", "instances"), "instances")
    return rows.select("topic", F.md5("value").alias("value"), "ord")


_BLANKS = "concat(" + ", ".join(
    f"chr({c})" for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                          0x202F, 0x205F, 0x3000)) + ")"


@_query("r6_tabular", f"""
select 'documents' as source_file, trim(source, {_BLANKS}) as topic, doc_id * 3 + pos as ord, md5(instance) as instance
from (select doc_id, source, unnest([trim(text, {_BLANKS}), trim(lang, {_BLANKS}), cast(n_chars as varchar)]) as instance,
  unnest([0, 1, 2]) as pos from documents) where trim(source, {_BLANKS}) <> ''""")
def _(t: Tables) -> DataFrame:
    table = t.documents.select("source", "text", "lang", "n_chars", "doc_id")
    rows = tabular.tabular_rows(table, order_by="doc_id", source="documents")
    return rows.select("source_file", "topic", "ord", F.md5("instance").alias("instance"))


@_query("r6_falsy_topics", """
select 'labels' as source_file, cast(quality as varchar) as topic, doc_id as ord, cast(toxic as varchar) as instance
from labels where quality <> 0""")
def _(t: Tables) -> DataFrame:
    table = t.labels.select("quality", "toxic", "doc_id")
    return tabular.tabular_rows(table, order_by="doc_id", source="labels")


@_query("l7_first_samples", """
select 'orders' as source_file, o_orderpriority as topic, o_orderkey as ord, o_orderstatus as instance
from orders order by o_orderkey limit 1000""")
def _(t: Tables) -> DataFrame:
    table = t.orders.select("o_orderpriority", "o_orderstatus", "o_orderkey")
    return tabular.tabular_rows(table, order_by="o_orderkey", max_samples=1000, source="orders")


@_query("a8_ordered_distinct", f"""
select lang, md5(trim(text, {_BLANKS})) as text, min(doc_id) as doc_id from documents
where trim(text, {_BLANKS}) <> '' group by 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = aggregate.ordered_distinct(t.documents.select("lang", "text", "doc_id"), "lang", "text", "doc_id")
    return rows.select("lang", F.md5("text").alias("text"), "doc_id")


@_query("a12_group_mean", """
select topic_id, pos, round(avg(value), 6) as mean from (
  select topic_id, unnest(range(len(content_embedding))) as pos, unnest(content_embedding) as value
  from memory_instances) group by 1, 2""", "memory_instances")
def _(t: Tables) -> DataFrame:
    means = vectors.group_mean(t.instances, ["topic_id"], "content_embedding", "centre")
    return means.select("topic_id", F.posexplode("centre").alias("pos", "mean")).withColumn(
        "mean", F.round("mean", 6))


@_query("a9_small_topics", """
select id, topic_id from (select *, count(*) over (partition by topic_id) as n from memory_instances) where n < 3""",
        "memory_instances")
def _(t: Tables) -> DataFrame:
    return discover.small_topic_instances(t.instances).select("id", "topic_id")


@_query("f1_embed_hashed", """
select doc_id, 64 as width, case when regexp_matches(text, '[\\pL\\pN_\\pM]') then 1.0 else 0.0 end as length
from documents""")
def _(t: Tables) -> DataFrame:
    embedded = embed_hashed(t.documents.select("doc_id", "text"), "text", 64)
    return embedded.select("doc_id", F.size("embedding").alias("width"),
                           F.round(vectors.norm(F.col("embedding")), 4).alias("length"))


# --- ingest ------------------------------------------------------------------

# Entries are walked in order; ``created`` lists those that made a topic.
_INGEST = f"""with recursive
filled as (select * from ingest_entries e where exists (select 1 from ingest_instances i where i.entry_ord = e.entry_ord)),
stored as (
  select entry_ord, arg_min(id, (-similarity, id)) as stored_id, max(similarity) as stored_sim from (
    select entry_ord, t.id, round({_COS}(e.topic_embedding, t.topic_embedding), 12) as similarity
    from filled e cross join memory_topics t) group by 1),
pairs as (
  select a.entry_ord as later, b.entry_ord as earlier, round({_COS}(a.topic_embedding, b.topic_embedding), 12) as similarity
  from filled a join filled b on b.entry_ord < a.entry_ord),
turns as (
  select s.entry_ord, row_number() over (order by s.entry_ord) as n, stored_sim > 0.9 as covered,
    (select coalesce(list(earlier), []) from pairs p where p.later = s.entry_ord and similarity > 0.9) as near
  from stored s),
walk(n, created) as (
  select 0::bigint, []::bigint[]
  union all
  select w.n + 1, case when t.covered or list_has_any(t.near, w.created) then w.created
    else list_append(w.created, t.entry_ord) end
  from walk w join turns t on t.n = w.n + 1),
created as (select unnest(created) as entry_ord from walk where n = (select max(n) from walk)),
best as (
  select later, arg_min(earlier, (-similarity, earlier)) as earlier, max(similarity) as similarity
  from pairs where earlier in (select entry_ord from created) and similarity > 0.75 group by 1),
resolved as (
  select s.entry_ord, s.entry_ord in (select entry_ord from created) as is_created,
    case when b.similarity > s.stored_sim then concat('entry_', cast(b.earlier as varchar)) else s.stored_id end as nearest,
    greatest(s.stored_sim, b.similarity) as similarity
  from stored s left join best b on b.later = s.entry_ord)"""

_INGEST_TABLES = "ingest_entries ingest_instances memory_topics"


def _named_resolution(t: Tables, limits: SimilarityLimits = SimilarityLimits()) -> DataFrame:
    entries = t.ingest_entries.join(t.ingest_instances.select("entry_ord"), "entry_ord", "left_semi")
    resolved = cut_lineage(ingest.resolve_entries(entries, t.topics, limits=limits))
    made = resolved.filter("is_created").select(F.col("topic_id").alias("nearest_id"), F.col("topic").alias("made"))
    return resolved.join(made, "nearest_id", "left").withColumn("nearest", F.coalesce("made", "nearest_id"))


_RESOLVED = _INGEST + """
select entry_ord, is_created, case when similarity > 0.75 then nearest end as nearest,
  case when similarity > 0.75 then round(similarity, 6) end as similarity from resolved"""


def _resolution(t: Tables, limits: SimilarityLimits) -> DataFrame:
    return _named_resolution(t, limits).select(
        "entry_ord", "is_created", "nearest", F.round("nearest_similarity", 6).alias("similarity"))


@_query("u1_resolve_topics", _RESOLVED, _INGEST_TABLES)
def _(t: Tables) -> DataFrame:
    return _resolution(t, SimilarityLimits())


@_query("u1_partitioned", _RESOLVED, _INGEST_TABLES)
def _(t: Tables) -> DataFrame:
    return _resolution(t, SMALL_LIMITS)


@_query("u2_auto_links", _INGEST + """
select nearest as from_topic, entry_ord as to_entry, round(similarity, 6) as weight
from resolved where is_created and similarity > 0.75""", _INGEST_TABLES)
def _(t: Tables) -> DataFrame:
    resolved = _named_resolution(t)
    owners = resolved.select(F.col("topic_id").alias("to_topic"), "entry_ord", "nearest").filter("is_created")
    links = ingest.link_edges(resolved)
    return links.join(owners, "to_topic").select(
        F.col("nearest").alias("from_topic"), F.col("entry_ord").alias("to_entry"), _six("weight"))


_IMPORTED = _INGEST + """,
homes as (
  select entry_ord, case when is_created then concat('entry_', cast(entry_ord as varchar)) else nearest end as home
  from resolved),
placed as (
  select h.home, i.*, list_distance(e.topic_embedding, i.content_embedding::double[]) as gap
  from ingest_instances i join homes h on h.entry_ord = i.entry_ord join filled e on e.entry_ord = i.entry_ord),
added as (
  select * from (select *, min(entry_ord) over (partition by home, content) as first_entry from placed p
    where not exists (select 1 from memory_instances m where m.topic_id = p.home and m.content = p.content))
  where entry_ord = first_entry)"""


def _import(t: Tables) -> ingest.Ingested:
    return ingest.ingest(t.snapshot, t.ingest_entries, t.ingest_instances, as_of=AS_OF)


@_query("w2_added_instances", _IMPORTED + """
select entry_ord, inst_ord, home, round(greatest(0, 1 - gap / 2), 6) as relevance_score, 0.5 as importance from added""",
        _INGEST_TABLES + " memory_instances")
def _(t: Tables) -> DataFrame:
    done = _import(t)
    made = done.resolved.filter("is_created").select("topic_id", F.col("topic").alias("made"))
    stored = done.snapshot.instances.select("id", "topic_id", "relevance_score", "importance")
    numbered = done.added_instances.select("id", "entry_ord", "inst_ord")
    return numbered.join(stored, "id").join(made, "topic_id", "left").select(
        "entry_ord", "inst_ord", F.coalesce("made", "topic_id").alias("home"), _six("relevance_score"), "importance")


# The same entries once more with the same clock, half of their texts being new.
_IMPORTED_TWICE = _IMPORTED + f""",
topics_after as (
  select id, topic_embedding from memory_topics
  union all select concat('entry_', cast(entry_ord as varchar)), topic_embedding from filled
    where entry_ord in (select entry_ord from created)),
homes_after as (
  select entry_ord, arg_min(id, (-similarity, id)) as home from (
    select entry_ord, t.id, round({_COS}(e.topic_embedding, t.topic_embedding), 12) as similarity
    from filled e cross join topics_after t) group by 1),
texts_after as (
  select topic_id as home, content from memory_instances union all select home, content from added),
offered as (
  select home, entry_ord, content || case when inst_ord % 2 = 1 then ' again' else '' end as content
  from ingest_instances join homes_after using (entry_ord)),
added_again as (
  select home, content from (select *, min(entry_ord) over (partition by home, content) as first_entry from offered o
    where not exists (select 1 from texts_after t where t.home = o.home and t.content = o.content))
  where entry_ord = first_entry),
texts_at_end as (select * from texts_after union all select * from added_again)"""


def _import_twice(t: Tables) -> tuple[Snapshot, DataFrame]:
    # Texts are joined with their vectors once; both imports read the columns that they need of the written rows.
    stored, offered = t.snapshot.with_tables(instances=written(t.instances)), written(t.ingest_instances)
    once = ingest.ingest(stored, t.ingest_entries, offered, as_of=AS_OF)
    texts = offered.withColumn("content", F.concat("content", F.when(F.col("inst_ord") % 2 == 1, " again").otherwise("")))
    # Instances are written rows already: the stored ones and those that were added.
    kept = Snapshot(cut_lineage(once.snapshot.topics), once.snapshot.instances, cut_lineage(once.snapshot.edges))
    return ingest.ingest(kept, t.ingest_entries, texts, as_of=AS_OF).snapshot, once.resolved


@_query("w4_two_imports", _IMPORTED_TWICE + """
select home, sha256(content) as content_sha256, count(*) as n_instances, count(*) as n_ids from texts_at_end group by 1, 2""",
        _INGEST_TABLES + " memory_instances")
def _(t: Tables) -> DataFrame:
    after, resolved = _import_twice(t)
    made = resolved.filter("is_created").select("topic_id", F.col("topic").alias("made"))
    held = after.instances.select("id", "topic_id", F.sha2("content", 256).alias("content_sha256"))
    return held.join(made, "topic_id", "left").groupBy(F.coalesce("made", "topic_id").alias("home"), "content_sha256").agg(
        F.count(F.lit(1)).alias("n_instances"), F.count_distinct("id").alias("n_ids"))


@_query("w4_two_imports_constraints", """
select unnest(['topics_range', 'instances_range', 'edges_range', 'topics_key', 'instances_key', 'edges_key', 'dangling']) as check,
  0::bigint as n_rows""")
def _(t: Tables) -> DataFrame:
    return violations(_import_twice(t)[0])


@_query("w3_created_topics", _INGEST + f"""
select concat('entry_', cast(entry_ord as varchar)) as topic_name, 1.0 as strength, 0 as access_count, {_TS} as last_accessed,
  {_TS} as created_at, 0.1 as decay_rate, 7.0 as half_life_days, '{{}}' as metadata from resolved where is_created""",
        _INGEST_TABLES)
def _(t: Tables) -> DataFrame:
    before = t.topics.select("id")
    return _import(t).snapshot.topics.join(before, "id", "left_anti").select(
        "topic_name", "strength", "access_count", "last_accessed", "created_at", "decay_rate", "half_life_days", "metadata")


@_query("w1_entry_report", _IMPORTED + """
select e.entry_ord, e.topic, e.entry_ord in (select entry_ord from filled) as is_added,
  (select count(*) from added a where a.entry_ord = e.entry_ord) as n_added from ingest_entries e""",
        _INGEST_TABLES + " memory_instances")
def _(t: Tables) -> DataFrame:
    return _import(t).report


@_query("a15_batch_summary", """
select count(*) as n_entries, count(*) filter (where entry_ord in (select entry_ord from ingest_instances)) as n_succeeded,
  count(*) = count(*) filter (where entry_ord in (select entry_ord from ingest_instances)) as all_succeeded
from ingest_entries""", "ingest_entries ingest_instances")
def _(t: Tables) -> DataFrame:
    return ingest.batch_summary(_import(t).report)


# Every edge is offered again, and its reverse, with half its weight plus 0.3.
_OFFERS = """
select from_topic, to_topic, round(weight / 2 + 0.3, 6) as weight from topic_edges
union all select to_topic, from_topic, round(weight / 2 + 0.3, 6) from topic_edges"""


@_query("w5_edge_upsert", f"""
with offers as (select from_topic, to_topic, max(weight) as weight from ({_OFFERS}) group by 1, 2)
select coalesce(e.from_topic, o.from_topic) as from_topic, coalesce(e.to_topic, o.to_topic) as to_topic,
  greatest(e.weight, o.weight) as weight, coalesce(e.last_activated, {_TS}) as last_activated
from topic_edges e full join offers o on e.from_topic = o.from_topic and e.to_topic = o.to_topic""", "topic_edges")
def _(t: Tables) -> DataFrame:
    edges = t.edges
    offers = t.spark.sql(_OFFERS.replace("topic_edges", "{topic_edges}"), topic_edges=edges)
    return ingest.upsert_edges(edges, offers, AS_OF).select("from_topic", "to_topic", "weight", "last_activated")


# --- clustering, discovery, merging ------------------------------------------

_DBSCAN = f"""with recursive
points as (
  select id, content, content_embedding from (
    select *, count(*) over (partition by topic_id) as n from memory_instances) where n < 3),
near as (
  select a.id as a, b.id as b from points a cross join points b
  where 1 - {_COS}(a.content_embedding, b.content_embedding) <= 0.3),
cores as (select a as id from near group by a having count(*) >= 5),
links as (select a, b from near where a in (select id from cores) and b in (select id from cores)),
reach(a, b) as (
  select a, b from links
  union
  select r.a, l.b from reach r join links l on l.a = r.b),
named as (select a as id, min(b) as cluster from reach group by a),
clustered as (
  select id, true as is_core, cluster from named
  union all
  select n.a, false, min(m.cluster) from near n join named m on m.id = n.b
  where n.a not in (select id from cores) group by n.a)"""


@_query("a16_dbscan", _DBSCAN + """
select p.id, coalesce(c.is_core, false) as is_core, c.cluster from points p left join clustered c on c.id = p.id""",
        "memory_instances")
def _(t: Tables) -> DataFrame:
    return density.dbscan(discover.small_topic_instances(t.instances), "id", "content_embedding")


@_query("a16_partitioned", _DBSCAN + """
select p.id, coalesce(c.is_core, false) as is_core, c.cluster from points p left join clustered c on c.id = p.id""",
        "memory_instances")
def _(t: Tables) -> DataFrame:
    return density.dbscan(discover.small_topic_instances(t.instances), "id", "content_embedding", limits=SMALL_LIMITS)


@_query("a16_kept_up_to_date")
def _(t: Tables) -> DataFrame:
    # The instances come in two batches; some of the first ones are taken away and come back with the second.
    loose = cut_lineage(discover.small_topic_instances(t.instances).select("id", "content_embedding"))
    part = F.pmod(F.xxhash64("id"), F.lit(4))
    first = density_update.update_clusters(None, loose.filter(part < 3), id_="id", vector="content_embedding")
    second = density_update.update_clusters(first, loose.filter(part > 1), loose.filter(part == 2).select("id"), "id", "content_embedding")
    return second.select("id", "is_core", "cluster")


ORACLES["a16_kept_up_to_date"] = ORACLES["a16_dbscan"]


@_query("u13_discovered", _DBSCAN + """
select concat('[INFO] Automatically discovered: ', substr(arg_min(p.content, p.id), 1, 30)) as topic_name,
  c.cluster, count(*) as n_members, round(avg(p.content_embedding[1]), 6) as first_coordinate
from points p join clustered c on c.id = p.id group by c.cluster""", "memory_instances")
def _(t: Tables) -> DataFrame:
    loose = discover.small_topic_instances(t.instances)
    found = density.dbscan(loose, "id", "content_embedding").filter(F.col("cluster").isNotNull())
    members = cut_lineage(found.join(loose.select("id", "content", "content_embedding"), "id"))
    return discover.discovered_topics(members, t.topics).select(
        "topic_name", "cluster", "n_members", F.round(F.element_at("topic_embedding", 1), 6).alias("first_coordinate"))


@_query("u13_reassigned", _DBSCAN + """
select i.id, case when c.cluster is null then i.topic_id else concat('cluster of ', c.cluster) end as topic_id
from memory_instances i left join clustered c on c.id = i.id""", "memory_instances")
def _(t: Tables) -> DataFrame:
    before = t.snapshot
    after = discover.discover_topics(before, as_of=AS_OF)
    moved = after.instances.select("id", "topic_id").join(
        before.topics.select(F.col("id").alias("topic_id"), F.lit(True).alias("is_old")), "topic_id", "left")
    # A new topic is known here by the lowest id among its members.
    lowest = moved.filter(F.col("is_old").isNull()).groupBy("topic_id").agg(F.min("id").alias("lowest"))
    core = density.dbscan(discover.small_topic_instances(before.instances), "id", "content_embedding").filter("is_core")
    named = moved.join(core.select("id", "cluster"), "id").groupBy("topic_id").agg(F.min("cluster").alias("cluster"))
    return moved.join(lowest, "topic_id", "left").join(named, "topic_id", "left").select(
        "id", F.when(F.col("is_old").isNull(), F.concat(F.lit("cluster of "), "cluster")).otherwise(
            F.col("topic_id")).alias("topic_id"))


_MERGE = f"""with recursive
pairs as {_PAIRS.replace('0.85', '0.92').join(['(', ')'])},
parents as (select id2 as node, arg_min(id1, rank) as parent from pairs group by id2),
climb(node, above) as (
  select node, parent from parents
  union
  select c.node, p.parent from climb c join parents p on p.node = c.above),
targets as (select node as merged_id, above as kept_id from climb where above not in (select node from parents))"""


@_query("u14_merge", _MERGE + " select merged_id, kept_id from targets", "memory_topics")
def _(t: Tables) -> DataFrame:
    return merge.merge_plan(t.topics, 0.92)


@_query("u14_merged_tables", _MERGE + """
select 'instances' as kind, i.id as a, coalesce(t.kept_id, i.topic_id) as b, null as weight
from memory_instances i left join targets t on t.merged_id = i.topic_id
union all
select 'edges', coalesce(f.kept_id, e.from_topic), coalesce(t.kept_id, e.to_topic), max(weight)
from topic_edges e left join targets f on f.merged_id = e.from_topic left join targets t on t.merged_id = e.to_topic
group by 1, 2, 3
union all
select 'topics', id, null, null from memory_topics where id not in (select merged_id from targets)""", _ALL)
def _(t: Tables) -> DataFrame:
    after = merge.merge_similar(t.snapshot, 0.92)
    nothing = F.lit(None)
    return after.instances.select(
        F.lit("instances").alias("kind"), F.col("id").alias("a"), F.col("topic_id").alias("b"),
        nothing.cast("double").alias("weight"),
    ).unionByName(after.edges.select(
        F.lit("edges").alias("kind"), F.col("from_topic").alias("a"), F.col("to_topic").alias("b"), "weight")
    ).unionByName(after.topics.select(
        F.lit("topics").alias("kind"), F.col("id").alias("a"), nothing.cast("string").alias("b"),
        nothing.cast("double").alias("weight")))


@_query("u14_merge_all", f"""with recursive
parents as (
  select node, parent from (
    select b.id as node, a.id as parent, row_number() over (partition by b.id
      order by round({_COS}(a.topic_embedding, b.topic_embedding), 12) desc, a.id) as rank
    from memory_topics a join memory_topics b on a.id < b.id
    where {_COS}(a.topic_embedding, b.topic_embedding) > 0.92) where rank = 1),
climb(node, above) as (
  select node, parent from parents
  union
  select c.node, p.parent from climb c join parents p on p.node = c.above)
select node as merged_id, above as kept_id from climb where above not in (select node from parents)""", "memory_topics")
def _(t: Tables) -> DataFrame:
    return merge.merge_plan(t.topics, 0.92, max_pairs=None)


@_query("u14_merge_all_partitioned", f"""with recursive
parents as (
  select node, parent from (
    select b.id as node, a.id as parent, row_number() over (partition by b.id
      order by round({_COS}(a.topic_embedding, b.topic_embedding), 12) desc, a.id) as rank
    from memory_topics a join memory_topics b on a.id < b.id
    where {_COS}(a.topic_embedding, b.topic_embedding) > 0.92) where rank = 1),
climb(node, above) as (
  select node, parent from parents
  union
  select c.node, p.parent from climb c join parents p on p.node = c.above)
select node as merged_id, above as kept_id from climb where above not in (select node from parents)""", "memory_topics")
def _(t: Tables) -> DataFrame:
    return merge.merge_plan(t.topics, 0.92, max_pairs=None, limits=SMALL_LIMITS)


_LEADERS = f"""with recursive
pairs as (
  select a.vec_id as later, b.vec_id as earlier, round({_COS}(a.v, b.v), 12) as similarity
  from mixed a join mixed b on b.vec_id < a.vec_id),
turns as (
  select m.vec_id, row_number() over (order by m.vec_id) as n,
    (select coalesce(list(earlier), []) from pairs p where p.later = m.vec_id and similarity > 0.7) as near
  from mixed m),
walk(n, leaders) as (
  select 0::bigint, []::bigint[]
  union all
  select w.n + 1, case when list_has_any(t.near, w.leaders) then w.leaders else list_append(w.leaders, t.vec_id) end
  from walk w join turns t on t.n = w.n + 1),
leaders as (select unnest(leaders) as vec_id from walk where n = (select max(n) from walk))
select m.vec_id as ord, coalesce(
  (select arg_min(earlier, (-similarity, earlier)) from pairs p where p.later = m.vec_id and similarity > 0.7
    and earlier in (select vec_id from leaders)), m.vec_id) as cluster
from mixed m"""


@_query("a7_leader_clusters", _LEADERS.replace("recursive\n", """recursive
mixed as (select cast(substr(id, 2) as bigint) as vec_id, topic_embedding as v from memory_topics),
""", 1), "memory_topics")
def _(t: Tables) -> DataFrame:
    texts = t.topics.select(F.lit("topics").alias("source_file"), F.substring("id", 2, 9).cast("long").alias("ord"),
                            F.col("topic_name").alias("text"), F.col("topic_embedding").alias("embedding"))
    return clusters.leader_clusters(texts).select("ord", "cluster")


# Clusters by leaders, each named by the member nearest to its mean; names are longer than what is kept of them.
@_query("l11_representatives", _LEADERS.replace("recursive\n", """recursive
mixed as (select cast(substr(id, 2) as bigint) as vec_id, topic_embedding as v from memory_topics),
""", 1).replace("select m.vec_id as ord, coalesce(", "select * from (with found as (select m.vec_id as ord, m.v, coalesce(", 1) + f"""),
spread as (select cluster, unnest(v) as x, generate_subscripts(v, 1) as place from found),
means as (select cluster, list(x order by place) as centre, any_value(n) as n from (
  select cluster, place, avg(x) as x, count(*) as n from spread group by 1, 2) group by cluster),
named as (
  select cluster, arg_min(ord, (-round({_COS}(v, centre), 12), ord)) as first from found join means using (cluster) where n >= 2 group by 1)
select ord, cluster, substr(repeat('topic ' || cast(first as varchar) || ' ', 20), 1, 80) as topic from found join named using (cluster))""",
        "memory_topics")
def _(t: Tables) -> DataFrame:
    ord_ = F.substring("id", 2, 9).cast("long")
    texts = t.topics.select(F.lit("topics").alias("source_file"), ord_.alias("ord"),
                            F.repeat(F.concat(F.lit("topic "), ord_.cast("string"), F.lit(" ")), 20).alias("text"),
                            F.col("topic_embedding").alias("embedding"))
    named = clusters.cluster_topics(cut_lineage(clusters.leader_clusters(texts)), 2)
    return named.select("ord", "cluster", "topic")


@_query("f6_vector_width", "select vec_id, least(60 + label, 64) as width from embeddings where 60 + label < 64")
def _(t: Tables) -> DataFrame:
    cut = t.embeddings.select("vec_id", F.slice("embedding", F.lit(1), 60 + F.col("label")).alias("vector"))
    return width_violations(cut, "vector", vector_width(t.embeddings, "embedding")).select("vec_id", F.size("vector").alias("width"))


_MAINTAINED = _DBSCAN + f""",
coordinates as (
  select cluster, pos, avg(value) as value from (
    select c.cluster, unnest(range(len(p.content_embedding))) as pos, unnest(p.content_embedding) as value
    from points p join clustered c on c.id = p.id) group by 1, 2),
discovered as (
  select cluster, sha256(concat_ws(chr(1), 'discovered', '{AS_OF}', cluster)) as id,
    list(value order by pos) as topic_embedding from coordinates group by 1),
grown as (
  select id, topic_embedding, strength, access_count from memory_topics
  union all select id, topic_embedding, 1.0, 0 from discovered),
faded as (
  select * from (select from_topic, to_topic, case when weight > 0.1 then weight * 0.95 else weight end as weight
    from topic_edges) where not weight < 0.05),
pairs as ({_PAIRS.replace('0.85', '0.92').replace('memory_topics', 'grown')}),
parents as (select id2 as node, arg_min(id1, rank) as parent from pairs group by id2),
climb(node, above) as (
  select node, parent from parents
  union
  select c.node, p.parent from climb c join parents p on p.node = c.above),
targets as (select node as merged_id, above as kept_id from climb where above not in (select node from parents)),
owned as (
  select i.id, coalesce(t.kept_id, d.id, i.topic_id) as topic_id
  from memory_instances i left join clustered c on c.id = i.id left join discovered d on d.cluster = c.cluster
  left join targets t on t.merged_id = coalesce(d.id, i.topic_id)),
joined as (
  select coalesce(f.kept_id, e.from_topic) as from_topic, coalesce(t.kept_id, e.to_topic) as to_topic, max(weight) as weight
  from faded e left join targets f on f.merged_id = e.from_topic left join targets t on t.merged_id = e.to_topic
  group by 1, 2),
merged as (select * from grown where id not in (select merged_id from targets)),
kept as (
  select * from merged where not (id not in (select from_topic from joined) and id not in (select to_topic from joined)
    and strength < 0.1 and access_count < 2))"""


@_query("u16_maintain", _MAINTAINED + """
select (select count(*) from kept) as total_topics,
  (select count(*) from owned where topic_id in (select id from kept)) as total_instances,
  (select count(*) from joined) as total_edges, (select round(avg(strength), 6) from kept) as avg_topic_strength,
  (select round(avg(weight), 6) from joined) as avg_edge_weight,
  (select count(*) from kept where strength > 0.5) as strong_topics,
  (select count(*) from kept where strength < 0.2) as weak_topics""", _ALL)
def _(t: Tables) -> DataFrame:
    return graph.stats(maintain(t.snapshot, AS_OF)).withColumns({
        "avg_topic_strength": F.round("avg_topic_strength", 6), "avg_edge_weight": F.round("avg_edge_weight", 6)})


@_query("u16_maintained_instances", _MAINTAINED + """
select id, topic_id from owned where topic_id in (select id from kept)""", _ALL)
def _(t: Tables) -> DataFrame:
    return maintain(t.snapshot, AS_OF).instances.select("id", "topic_id")


@_query("w6_graph_json", """
select 'edges' as part, from_topic as a, to_topic as b, weight as x, cast(activation_count as bigint) as n
from topic_edges where weight > 0.2
union all select 'nodes', t.id, topic_name, strength, (select count(*) from memory_instances i where i.topic_id = t.id)
from memory_topics t
union all select 'stats', null, null, round((select avg(strength) from memory_topics), 6),
  (select count(*) from memory_topics) + (select count(*) from memory_instances)
  + (select count(*) from topic_edges where weight > 0.2)""", "memory_topics memory_instances topic_edges")
def _(t: Tables) -> DataFrame:
    # What the JSON sink wrote, read back.
    place = f"{ensure_checkpoint_dir(t.spark)}/graph-{uuid.uuid4().hex}"
    snapshot = t.snapshot
    tables.write_graph(snapshot, place)
    nodes, edges, stats_ = tables.read_graph(t.spark, place, snapshot)
    nothing = F.lit(None).cast("string")
    total = F.col("total_topics") + F.col("total_instances") + F.col("total_edges")
    return (edges.select(F.lit("edges").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"),
                         F.col("weight").alias("x"), F.col("activation_count").cast("long").alias("n"))
            .unionByName(nodes.select(F.lit("nodes").alias("part"), F.col("id").alias("a"), F.col("label").alias("b"),
                                      F.col("strength").alias("x"), F.col("instance_count").alias("n")))
            .unionByName(stats_.select(F.lit("stats").alias("part"), nothing.alias("a"), nothing.alias("b"),
                                       F.round("avg_topic_strength", 6).alias("x"), total.alias("n"))))


@_query("r8_instance_scan", """
select id, content, len(content_embedding) as width, topic_id from memory_instances""", "memory_instances")
def _(t: Tables) -> DataFrame:
    return tables.instance_vectors(t.instances).select("id", "content", F.size("content_embedding").alias("width"), "topic_id")


@_query("w7_topic_map_lines", """
select subject as topic, string_agg(concat(relation, ' ', object), '|' order by concat(relation, ' ', object)) as texts,
  count(*) as n_texts from triples group by source_file, subject""", _TRIPLES)
def _(t: Tables) -> DataFrame:
    # Written one topic to a line, and read back.
    place = f"{ensure_checkpoint_dir(t.spark)}/lines-{uuid.uuid4().hex}"
    topic_map.write_topic_map(aggregate.convert(t.triples, "subject"), place)
    rows = topic_map.topic_map_rows(topic_map.read_topic_map_lines(t.spark, place)[0])
    return rows.groupBy("topic").agg(
        F.array_join(F.array_sort(F.collect_list("instance")), "|").alias("texts"), F.count(F.lit(1)).alias("n_texts"))


@_query("t4_stream_totals", """
select topic_id, date_trunc('hour', ts) as hour, count(*) as n_accesses, max(ts) as last_access
from access_log group by 1, 2""", "access_log")
def _(t: Tables) -> DataFrame:
    # The event table as a stream of files, counted per topic and hour.
    name = "events.parquet"
    schema = t.events.schema
    events = t.spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(t.folder)
    log = events.select(
        F.concat(F.lit("t"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("topic_id"),
        F.col("ts").cast("timestamp").alias("ts"))
    place = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/totals")

    totals = loops.access_totals(log)
    totals.writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{place}/totals").select(
        "topic_id", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n_accesses",
        F.col("last_access").cast("timestamp_ntz").alias("last_access"))


# Accesses one after the other, and what has faded away before each or at the end.
_FADED = "greatest(strength * pow(0.5, greatest(epoch_us({now}) - epoch_us(last_accessed), 0) / 86400000000 / half_life_days), 0.01)"
_FORGOTTEN = f"({_FADED} < 0.05 and last_accessed < {{now}} - interval '30 days' and access_count < 5)"


@_query("t4_ordered_fold", f"""with recursive
mark as (select max(ts) - interval '10 minutes' as now from access_log),
accesses as (
  select a.topic_id, a.ts, row_number() over (partition by a.topic_id order by a.ts) as n
  from access_log a join mark on a.ts <= mark.now),
walk(id, n, strength, access_count, last_accessed, half_life_days, is_evicted) as (
  select id, 0::bigint, strength, access_count, last_accessed, half_life_days, false from memory_topics
  union all
  select w.id, w.n + 1, least({_FADED.format(now="a.ts")} + 0.1, 1.0), w.access_count + 1, greatest(last_accessed, a.ts),
    half_life_days * 1.1, {_FORGOTTEN.format(now="a.ts")}
  from walk w join accesses a on a.topic_id = w.id and a.n = w.n + 1 where not w.is_evicted),
ends as (select id, arg_max(w, n) as w from walk w group by id)
select id, round(w.strength, 6) as strength, w.access_count as access_count, w.last_accessed as last_accessed,
  round(ln(w.half_life_days), 6) as log_half_life
from (select id, w, {_FORGOTTEN.replace("strength", "w.strength").replace("last_accessed", "w.last_accessed")
  .replace("half_life_days", "w.half_life_days").replace("access_count", "w.access_count").format(now="mark.now")} as weak
  from ends cross join mark) where not weak and not w.is_evicted""", "memory_topics access_log")
def _(t: Tables) -> DataFrame:
    # The whole event table as a stream; topics that are forgotten on the way are missing from the result.
    events = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    log = events.select(F.concat(F.lit("t"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("topic_id"), "ts")
    place = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(setting)
    t.spark.conf.set(setting, fading.STATE_STORE)
    try:
        fading.fading(log, t.topics).writeStream.format("parquet").option("path", f"{place}/out").option(
            "checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.set(setting, before)
    last = fading.last_changes(t.spark.read.parquet(f"{place}/out"))
    names = ("strength", "access_count", "last_accessed", "half_life_days")
    changed = last.select(F.col("topic_id").alias("id"), "is_evicted", *[F.col(c).alias(f"_{c}") for c in names])
    kept = t.topics.join(changed, "id", "left").filter(~F.coalesce("is_evicted", F.lit(False)))
    folded = kept.select("id", *[F.coalesce(f"_{c}", c).alias(c) for c in names])
    return folded.select("id", _six("strength"), "access_count", "last_accessed", F.round(F.log("half_life_days"), 6).alias("log_half_life"))


# --- streams over a stored memory --------------------------------------------


def _stored(t: Tables) -> str:
    path = f"{_scratch(t)}/memory"
    tables.save_snapshot(t.snapshot, path)
    return path


@_query("t2_import_stream", _IMPORTED + """
select home, sha256(content) as content_sha256, count(*) as n_instances from (
  select topic_id as home, content from memory_instances union all select home, content from added) group by 1, 2""",
        _INGEST_TABLES + " memory_instances")
def _(t: Tables) -> DataFrame:
    # The entries come in two batches, the earlier ones first; each start goes on where the last one ended.
    memory, inbox = _stored(t), f"{_scratch(t)}/inbox"
    entries = t.ingest_entries.select("entry_ord", F.col("topic").alias("text"), F.col("topic_embedding").alias("vector"))
    # Vectors are known by the digest of their text, so that texts are neither grouped nor shuffled to be looked up in.
    texts = t.ingest_instances.groupBy(F.sha2("content", 256).alias("digest")).agg(F.min_by("content_embedding", "inst_ord").alias("vector"))
    known = cut_lineage(entries.select(F.sha2("text", 256).alias("digest"), "vector").unionByName(
        texts.select("digest", F.col("vector").cast("array<double>"))))

    def vectors(df: DataFrame, column: str, out: str) -> DataFrame:
        named = known.select(F.col("digest").alias("_known"), F.col("vector").alias(out))
        return df.join(named, F.sha2(column, 256) == F.col("_known")).drop("_known")

    half = t.ingest_entries.agg(F.max("entry_ord")).first()[0] // 2
    size = t.ingest_instances.agg(F.max("inst_ord")).first()[0] + 1
    rows = t.ingest_instances.join(entries, "entry_ord").select(
        F.lit("stream").alias("source_file"), F.col("text").alias("topic"),
        (F.col("entry_ord") * size + F.col("inst_ord")).alias("ord"), F.col("content").alias("instance"), "entry_ord")
    schema = "source_file string, topic string, ord long, instance string"
    state = f"{_scratch(t)}/state"
    for part in (F.col("entry_ord") <= half, F.col("entry_ord") > half, None):
        if part is not None:
            rows.filter(part).drop("entry_ord").write.mode("append").parquet(inbox)
        stream = t.spark.readStream.schema(schema).parquet(inbox)
        loops.remember_stream(stream, memory, state, vectors, as_of=AS_OF).awaitTermination()
    after = tables.load_snapshot(t.spark, memory)
    made = after.topics.join(t.topics.select("id"), "id", "left_anti").select(F.col("id").alias("topic_id"), F.col("topic_name").alias("made"))
    held = after.instances.select("topic_id", F.sha2("content", 256).alias("content_sha256"))
    return held.join(made, "topic_id", "left").groupBy(
        F.coalesce("made", "topic_id").alias("home"), "content_sha256").agg(F.count(F.lit(1)).alias("n_instances"))


def _query_stream(t: Tables) -> tuple[str, str]:
    """All queries as a stream over a stored memory, started twice: the memory and the answers."""
    memory, place = _stored(t), _scratch(t)
    t.queries.write.parquet(f"{place}/asked")
    stream = t.spark.readStream.schema("query_id string, query_embedding array<float>").parquet(f"{place}/asked")
    for _ in range(2):
        loops.recall_stream(stream, memory, f"{place}/state", f"{place}/answers", as_of=AS_OF).awaitTermination()
    return memory, f"{place}/answers"


@_query("t3_query_stream")
def _(t: Tables) -> DataFrame:
    _, answers = _query_stream(t)
    return t.spark.read.parquet(answers).select(
        "query_id", "rank", "topic_id", "topic_name", _six("score"), F.size("contents").alias("n_contents"),
        F.md5(F.array_join("contents", "|")).alias("contents"))


@_query("t3_reinforced_topics")
def _(t: Tables) -> DataFrame:
    memory, _ = _query_stream(t)
    return tables.load_snapshot(t.spark, memory).topics.select("id", _six("strength"), "access_count", "last_accessed")


@_query("t1_maintained_memory")
def _(t: Tables) -> DataFrame:
    memory = _stored(t)
    loops.maintain_once(t.spark, memory, AS_OF)
    return graph.stats(tables.load_snapshot(t.spark, memory)).withColumns({
        "avg_topic_strength": F.round("avg_topic_strength", 6), "avg_edge_weight": F.round("avg_edge_weight", 6)})


# What goes through a stream or the store is what the batch gives.
ORACLES["t3_query_stream"] = ORACLES["g2_read"]
ORACLES["t3_reinforced_topics"] = ORACLES["u3_u4_reinforced_topics"]
ORACLES["t1_maintained_memory"] = ORACLES["u16_maintain"]
