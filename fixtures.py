"""Graph-memory tables derived from the given tables, in Spark SQL and DuckDB SQL.

Every table uses all rows of what it is derived from.  The two dialects differ
in names only, so each text is written once with these gaps:

  {blend(b,a,w)}  w*b + (1-w)*a, element by element
  {text(x)}       x as text
  {ts}            the fixed clock
  {idiv}          whole-number division
"""

from __future__ import annotations

AS_OF = "2024-01-31 00:00:00"


def _topic_id(dialect: dict, number: str) -> str:
    return f"concat('t', lpad(cast({number} as {dialect['text']}), 9, '0'))"


_SPARK = {"text": "string", "ts": f"timestamp_ntz'{AS_OF}'", "idiv": "div"}
_DUCKDB = {"text": "varchar", "ts": f"timestamp '{AS_OF}'", "idiv": "//"}


def _blend(dialect: dict, b: str, a: str, weight: str) -> str:
    if dialect is _SPARK:
        return f"zip_with({b}, {a}, (x, y) -> {weight} * cast(x as double) + (1D - {weight}) * cast(y as double))"
    weight = weight.replace("D", "::DOUBLE")
    return (f"list_transform(list_zip({b}, {a}), lambda p: {weight} * p[1]::DOUBLE "
            f"+ (1::DOUBLE - {weight}) * p[2]::DOUBLE)")


def _tables(d: dict) -> dict[str, str]:
    text = d["text"]

    def sized(table: str) -> str:
        return f"(select *, (select count(*) from embeddings) as n from {table})"

    return {
        # A topic leans towards the first vector of its group of five, so that
        # some topics are near-duplicates.
        "memory_topics": f"""
select {_topic_id(d, 'a.vec_id')} as id, concat('topic_', cast(a.vec_id as {text})) as topic_name,
  {_blend(d, 'b.embedding', 'a.embedding', '0.7D')} as topic_embedding,
  cast((a.vec_id * 37) % 100 + 1 as double) / 100 as strength, cast(a.vec_id % 7 as int) as access_count,
  {d['ts']} - (a.vec_id % 60) * interval '1' day as last_accessed,
  cast(3 + a.vec_id % 10 as double) as half_life_days
from embeddings a join embeddings b on b.vec_id = a.vec_id - a.vec_id % 5""",
        # Documents are spread over topics by length: some topics hold many,
        # some few, some none, and copies meet in one topic.
        "memory_instances": f"""
select concat('i', lpad(cast(o.doc_id as {text}), 9, '0')) as id, {_topic_id(d, '(o.n_chars % o.n)')} as topic_id,
  o.text as content, {_blend(d, 'b.embedding', 'a.embedding', '0.7D')} as content_embedding,
  cast((o.doc_id * 13) % 101 as double) / 100 as relevance_score,
  cast((o.doc_id * 29) % 101 as double) / 100 as importance,
  {d['ts']} - (o.doc_id % 90) * interval '1' day - interval '12' hour as last_accessed
from {sized('documents')} o
join embeddings a on a.vec_id = (o.doc_id * 7) % o.n
join embeddings b on b.vec_id = case when o.doc_id % 5 = 4 then a.vec_id
  else (o.n_chars % o.n) - (o.n_chars % o.n) % 25 end""",
        # Links between vectors whose labels are close; those of label 9 stay alone.
        "topic_edges": f"""
select distinct {_topic_id(d, 'q.f')} as from_topic, {_topic_id(d, 'q.g')} as to_topic,
  cast((q.f * 13 + q.g * 7) % 100 + 1 as double) / 100 as weight, cast(0 as int) as activation_count,
  {d['ts']} - ((q.f + q.g) % 20) * interval '1' day as last_activated
from (select vec_id as f, (vec_id * 7 + 1) % n as g from {sized('embeddings')} s
  union all select vec_id, (vec_id * 3 + 11) % n from {sized('embeddings')} s
  union all select vec_id, (vec_id * 11 + 5) % n from {sized('embeddings')} s
  union all select vec_id - vec_id % 25, vec_id from embeddings) q
join embeddings x on x.vec_id = q.f join embeddings y on y.vec_id = q.g
where q.f <> q.g and abs(x.label - y.label) <= 2 and greatest(x.label, y.label) < 9""",
        "triples": """
select 'customer' as source_file, c_custkey * 2 as triple_ord, c_name as subject, 'in segment' as relation,
  c_mktsegment as object from customer
union all select 'customer', c_custkey * 2 + 1, c_name, 'lives in', n_name
  from customer join nation on c_nationkey = n_nationkey
union all select 'supplier', s_suppkey, s_name, 'located in', n_name
  from supplier join nation on s_nationkey = n_nationkey
union all select 'nation', cast(n_nationkey as bigint), n_name, 'part of', r_name
  from nation join region on n_regionkey = r_regionkey""",
        "queries": f"""
select concat('q', lpad(cast(vec_id as {text}), 9, '0')) as query_id, embedding as query_embedding
from embeddings""",
        "access_log": f"""
select {_topic_id(d, 'user_id')} as topic_id, ts, event_type from events""",
        # Entries in pairs that lean on the same two vectors.
        "ingest_entries": f"""
select k.vec_id as entry_ord, concat('entry_', cast(k.vec_id as {text})) as topic,
  {_blend(d, 'b.embedding', 'x.embedding', '(0.5D + cast(k.vec_id % 3 as double) / 10D)')} as topic_embedding
from {sized('embeddings')} k
join embeddings b on b.vec_id = ((k.vec_id {d['idiv']} 2) * 5) % k.n
join embeddings x on x.vec_id = ((k.vec_id {d['idiv']} 2) * 11 + 3) % k.n""",
        # Documents are spread over entries by length; some entries get none.
        "ingest_instances": f"""
select (d.n_chars + d.doc_id % 2) % d.n as entry_ord, d.doc_id as inst_ord, d.text as content, x.embedding as content_embedding
from {sized('documents')} d join embeddings x on x.vec_id = (d.doc_id * 7) % d.n""",
    }


SPARK_SQL = _tables(_SPARK)
DUCKDB_SQL = _tables(_DUCKDB)
