"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.llm import (
    centroids, chat, covertree, fingerprints, hashforest, html_text, jaccard, lexical, mixing, pieces, ranking, secret_scan, substrings)

# The text of the conversation that op6 adds: control strings of another template.
PROBE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, limit=2.0).select(
        "doc_id", "size", "source_size", "target", "taken")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op4_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashforest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_chat(turns))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), shingle_words=4, percent=85, count_links=True).drop("mark")


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_table(spark, sf_dir, "documents"), pieces.read_model(), with_ids=False)


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.find_copies(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def _clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds one after the other: sums by cluster and place, rounded down, stand in for centroids that have vectors."""
    near = """
{a} AS MATERIALIZED (
  SELECT vec_id, arg_min(j, distance * {k} + j) AS cluster, min(distance) AS distance FROM (
    SELECT vec_id, j, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM items x CROSS JOIN {c} c) GROUP BY vec_id)"""
    moved = """
{c} AS MATERIALIZED (
  SELECT p.j, coalesce(m.v, p.v) AS v FROM {p} p LEFT JOIN (
    SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY place) AS v FROM (
      SELECT cluster, place, CAST(sum(x) AS BIGINT) AS total, count(*) AS n
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM {a} JOIN items USING (vec_id))
      GROUP BY cluster, place) GROUP BY cluster) m ON m.cluster = p.j)"""
    steps = []
    for r in range(rounds + 1):
        steps.append(near.format(a=f"a{r}", c=f"c{r}", k=k))
        if r < rounds:
            steps.append(moved.format(a=f"a{r}", c=f"c{r + 1}", p=f"c{r}"))
    return f"""
WITH items AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS j, v FROM (
    SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM items ORDER BY h LIMIT {k})),{",".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.j = cluster"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_quality_classifier, op3_cover_tree_top_k, op4_hash_forest, op5_substring_dedup, op6_chat_formatting,
        op7_ngram_jaccard, op8_piece_encoding, op9_page_text, op10_secret_scan, op11_lexical_search, op12_exact_dedup,
        op13_centroid_clustering)
}

ORACLES: dict[str, str] = {
    # A window is known by its words joined; the least document that holds it removes it from the others.
    "op5_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, string_split_regex(trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\x20\x09-\x0D]+') AS raw
  FROM documents),
words AS (SELECT doc_id, CASE WHEN raw IS NULL OR raw = [''] THEN CAST([] AS VARCHAR[]) ELSE raw END AS w FROM docs),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS body
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
lowest AS (SELECT body, min(doc_id) AS low FROM windows GROUP BY body HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place
  FROM windows JOIN lowest USING (body) WHERE doc_id > low),
spread AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS body
  FROM spread ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)""",
    "op3_cover_tree_top_k": r"""
WITH items AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM items q JOIN items c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    # Lengths of formatted turns follow from the template: 11 characters around a role and a text, one more for each escape.
    "op6_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 11 + length(role) + length(regexp_replace(role, '[^&<\[|]', '', 'g')) + length(text)
            + length(regexp_replace(text, '[^&<\[]', '', 'g')) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place
  FROM turns),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM sized),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS body,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss,
         sum(upto) FILTER (role = 'assistant' OR place = n) AS formatted_chars
  FROM running GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(body) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM whole""",
    "op11_lexical_search": r"""
WITH cut AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM cut GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts CROSS JOIN whole GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id) CROSS JOIN whole GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op12_exact_dedup": r"""
WITH read AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM read""",
    "op13_centroid_clustering": _clustering_sql(),
    # Shingles are known by their words joined; components are what links reach, the smallest id in each.
    "op7_ngram_jaccard": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\x20\x09-\x0D]+') AS raw FROM documents),
words AS (SELECT doc_id, CASE WHEN raw IS NULL OR raw = [''] THEN CAST([] AS VARCHAR[]) ELSE raw END AS w FROM docs),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [1] ELSE range(1, len(w) - 2) END) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT x, y FROM ways UNION SELECT r.doc_id, b.y FROM reach r JOIN ways b ON b.x = r.other),
lowest AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id),
counts AS (SELECT x AS doc_id, count(*) AS n FROM ways GROUP BY x)
SELECT doc_id, coalesce(s.n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, coalesce(c.n, 0) AS n_links
FROM words LEFT JOIN sizes s USING (doc_id) LEFT JOIN lowest USING (doc_id) LEFT JOIN counts c USING (doc_id)""",
}
