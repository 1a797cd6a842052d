import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fadegraph.functions import scoring, vectors
from fadegraph.functions.text import is_truthy, strip
from fadegraph.operators import aggregate, updates
from fadegraph.operators.clusters import kmeans_topics
from fadegraph.operators.graph import export_edges, export_nodes, export_stats, neighbors, orphans, stats
from fadegraph.schema import (complete, dangling, empty_snapshot, key_violations, range_violations, require_valid,
                              vector_width, width_violations)
from fadegraph.sources import openie, tables, tabular, topic_map
from tests import models
from tests.conftest import grouped_vectors
from tests.test_ingest_search import AS_OF, floats, make


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- triples ---

TRIPLES = "source_file string, triple_ord long, subject string, relation string, object string"


def topic_lists(rows):
    out = {}
    for r in rows.orderBy("ord").collect():
        out.setdefault(r["topic"], []).append(r["instance"])
    return out


def triple_frame(spark, triples):
    return spark.createDataFrame([("f", i, *t) for i, t in enumerate(triples)], TRIPLES)


def test_worked_examples(spark):
    apple = triple_frame(spark, [("Apple", "founded by", "Steve Jobs"), ("Apple", "headquartered in", "Cupertino")])
    assert topic_lists(aggregate.convert(apple, "subject")) == {
        "Apple": ["founded by Steve Jobs", "headquartered in Cupertino"]}
    both = triple_frame(spark, [("Apple", "founded by", "Steve Jobs"), ("Microsoft", "founded by", "Bill Gates")])
    assert topic_lists(aggregate.convert(both, "relation")) == {
        "founded by": ["Apple founded by Steve Jobs", "Microsoft founded by Bill Gates"]}
    circle = triple_frame(spark, [("Apple", "founded by", "Steve Jobs"), ("Steve Jobs", "co-founded", "Apple")])
    assert topic_lists(aggregate.convert(circle, "entity")) == {
        "Apple": ["founded by Steve Jobs", "Steve Jobs co-founded"],
        "Steve Jobs": ["Apple founded by", "co-founded Apple"]}
    with pytest.raises(ValueError):
        aggregate.convert(circle, "unknown")
    with pytest.raises(ValueError):
        aggregate.convert(circle, "semantic")


@pytest.mark.parametrize("least", [1, 2, 3])
def test_hybrid(spark, rng, least):
    triples = [(f"s{a}", f"s{b}" if c == 0 else f"r{b}", f"o{c}")
               for a, b, c in rng.integers(0, [12, 6, 4], size=(40, 3)).tolist()]
    subjects, relations = [t[0] for t in triples], [t[1] for t in triples]
    want = {}
    for s, r, o in triples:
        if subjects.count(s) >= least:
            want.setdefault(s, []).append(f"{r} {o}")
        elif relations.count(r) >= least:
            want.setdefault(r, []).append(f"{s} {r} {o}")
    want = {t: i for t, i in want.items() if len(i) >= least}
    assert topic_lists(aggregate.hybrid(triple_frame(spark, triples), least)) == want


def test_topic_arrays_are_whole_and_bounded(spark):
    rows = spark.range(1000).select(F.lit("f").alias("source_file"), F.lit("t").alias("topic"), F.col("id").alias("ord"),
                                    F.col("id").cast("string").alias("instance"))
    chunks = aggregate.topic_arrays(rows, 128).orderBy("chunk").collect()
    assert max(len(c["instances"]) for c in chunks) == 128
    assert [i for c in chunks for i in c["instances"]] == [str(i) for i in range(1000)]


LAYOUTS = [
    ('{"sentences":[{"triples":[{"subject":" A ","relation":"r","object":"o"}]},{"x":1}]}', "stanford", [("A", "r", "o")]),
    ('{"triples":null}', "generic", []),
    ('{"extractions":[{"arg1":"a","rel":"r","arg2":"b"}]}', "generic", [("a", "r", "b")]),
    ('{"triples":[{"subject":"","arg1":"a","relation":"r","object":"o"}],"extractions":[{"arg1":"x","rel":"y","arg2":"z"}]}',
     "generic", []),
    ('[{"arg1":"a","rel":"r","arg2":"b","confidence":0.5},{"arg1":"","rel":"r","arg2":"b"}]', "allennlp", [("a", "r", "b")]),
    ('[{"subject":"a","predicate":"r","object":"b"},{"subject":"  ","predicate":"r","object":"b"}]', "clausie",
     [("a", "r", "b"), ("", "r", "b")]),
    ("[]", "unknown", []),
    ('{"x":1}', "unknown", []),
]


def test_layouts(spark):
    files = spark.createDataFrame([(f"f{i}", t) for i, (t, _, _) in enumerate(LAYOUTS)], "source_file string, text string")
    got = dict(rows_of(files.select("source_file", openie.layout(F.col("text")).alias("layout")), "source_file", "layout"))
    assert got == {f"f{i}": name for i, (_, name, _) in enumerate(LAYOUTS)}
    found = {}
    for r in openie.triples(files).orderBy("source_file", "triple_ord").collect():
        found.setdefault(r["source_file"], []).append((r["subject"], r["relation"], r["object"]))
    assert found == {f"f{i}": t for i, (_, _, t) in enumerate(LAYOUTS) if t}


def test_triple_files(spark, tmp_path):
    (tmp_path / "b-openie.json").write_text(LAYOUTS[2][0])
    (tmp_path / "a-openie.json").write_text(json.dumps(json.loads(LAYOUTS[4][0]), indent=1))
    (tmp_path / "other.json").write_text(LAYOUTS[0][0])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c-openie.json").write_text(LAYOUTS[2][0])
    found = openie.read_triples(spark, str(tmp_path), "-openie.json").orderBy("source_file").collect()
    assert [r["source_file"].rsplit("/", 1)[1] for r in found] == ["a-openie.json", "b-openie.json"]
    assert openie.read_triples(spark, str(tmp_path), ".json").count() == 3


def test_bad_items_are_set_aside(spark):
    good = '{"subject":"a","predicate":"is","object":"b"}'
    files = spark.createDataFrame([
        ("one", f'[{good},"oops",{good}]'), ("two", f'[{good},'), ("three", "plain"), ("four", '{"triples":7}'),
        ("five", '{"sentences":[{"triples":[{"subject":"x","relation":"y","object":"z"},[1]]},5]}'), ("six", '{"triples":null}'),
        ("seven", None)], "source_file string, text string")
    got = {(r["source_file"], r["triple_ord"]) for r in openie.triples(files).collect()}
    assert got == {("one", 0), ("one", 2), ("five", 0)}
    bad = {(r["source_file"], r["position"], r["reason"]) for r in openie.quarantine(files).collect()}
    assert {b for b in bad if b[0] in ("one", "five", "six")} == {("one", 1, "not an object"), ("five", 1, "not an object")}
    assert {b[0] for b in bad} == {"one", "two", "three", "four", "five", "seven"}
    assert [r["source_file"] for r in openie.unread_records(files).orderBy("source_file").collect() if r["source_file"] != "seven"] == [
        "three", "two"]


def test_record_texts(spark):
    files = spark.createDataFrame([
        ("a", '[{"sentence":"one","text":"no"},{"sentence":"","text":"two"},{"surface":"three"},{"x":1}]'),
        ("b", '[["four","x"],["five"]]'), ("c", '{"t":["six","seven"],"u":["eight"]}')], "source_file string, text string")
    got = rows_of(openie.record_texts(files).orderBy("source_file", "ord"), "text")
    assert [t for (t,) in got] == ["one", "two", "three", "four", "five", "six", "seven", "eight"]


# --- topic maps and tables ---


def test_topic_map(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a":["old"],"b":["x","x",""],"s":"word","a":["new"],"n":null,"e":[]}')
    entries, bad = topic_map.read_topic_map(spark, str(tmp_path / "m.json"))
    rows = topic_map.topic_map_rows(entries)
    assert topic_lists(rows) == {"a": ["new"], "b": ["x", "x", ""]}
    assert sorted(r["topic"] for r in entries.collect()) == ["a", "b", "e"]
    assert sorted(r["topic"] for r in bad.collect()) == ["n", "s"]
    topic_map.write_topic_map(rows, str(tmp_path / "out"))
    again, _ = topic_map.read_topic_map_lines(spark, str(tmp_path / "out"))
    assert dict(rows_of(again, "topic", "instances")) == {"a": ["new"], "b": ["x", "x", ""]}


def test_tabular(spark):
    table = spark.createDataFrame([
        (0, " t ", " a ", None, 1.5), (1, "t", None, "", 2.0), (2, "", "a", "b", 1.0), (3, None, "a", "b", 1.0),
        (4, "u", " ", None, None), (5, "  ", "a", "b", 1.0), (6, "u", "x", "y", None)],
        "n long, topic string, p string, q string, r double")
    rows = tabular.tabular_rows(table, order_by="n")
    assert topic_lists(rows) == {"t": ["a", "1.5", "", "2.0"], "u": ["x", "y"]}
    assert topic_lists(tabular.tabular_rows(table, order_by="n", max_samples=1)) == {"t": ["a", "1.5"]}
    assert tabular.tabular_rows(table.select("topic")).count() == 0
    numbers = spark.createDataFrame([(0, "a"), (7, "b")], "k int, v string")
    assert topic_lists(tabular.tabular_rows(numbers)) == {"7": ["b"]}
    flags = spark.createDataFrame([(False, "a"), (True, "b")], "k boolean, v string")
    assert topic_lists(tabular.tabular_rows(flags)) == {"true": ["b"]}


def test_strip(spark):
    texts = [" 　 a b  \n", "\x1ca\x1f", "", " \n", "a"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()]
    assert got == [t.strip() for t in texts]


def test_snapshot_versions(spark, tmp_path):
    path = str(tmp_path / "memory")
    with pytest.raises(FileNotFoundError):
        tables.load_snapshot(spark, path)
    one = make(spark, [("a", [1.0], 0.5)], [("i", "a", "x", [1.0])], [("a", "a", 0.5)])
    assert tables.save_snapshot(one, path, batch=("s", 4)) == 1
    loaded = tables.load_snapshot(spark, path)
    assert tables.save_snapshot(loaded.with_tables(edges=loaded.edges.limit(0)), path) == 2
    assert tables.load_snapshot(spark, path).edges.count() == 0
    assert tables.load_snapshot(spark, path, 1).edges.count() == 1
    assert tables.load_version(spark, path).batches == {"s": 4}
    # A version whose job died has no marker and is not seen.
    one.topics.write.parquet(f"{path}/v=3/topics")
    assert tables.latest_version(spark, path) == 2
    tables.write_graph(one, str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph" / "stats")).first()["total_edges"] == 1


# --- constraints and reports ---


def test_violations(spark):
    bad = make(spark, [("a", [1.0], 1.5), ("a", [1.0, 2.0], 0.5)], [("i", "gone", "x", [1.0])], [("a", "b", 0.2)])
    assert rows_of(range_violations(bad.topics, "topics"), "strength") == [(1.5,)]
    assert rows_of(key_violations(bad.topics, "id"), "id", "n_rows") == [("a", 2)]
    assert width_violations(bad.topics, "topic_embedding", 1).count() == 1
    assert vector_width(bad.topics, "topic_embedding") in (1, 2)
    assert vector_width(bad.topics.limit(0), "topic_embedding") is None
    assert sorted(rows_of(dangling(bad), "table", "topic_id")) == [("edges", "b"), ("instances", "gone")]
    with pytest.raises(Exception, match="outside"):
        require_valid(bad.topics, "topics").collect()
    assert require_valid(bad.instances, "instances").count() == 1


def test_reports(spark):
    s = make(spark, [("a", [1.0], 0.6), ("b", [1.0], 0.1), ("c", [1.0], 0.2), ("d", [1.0], 0.3), ("e", [1.0], 0.29)],
             [("i", "a", "x", [1.0])], [("a", "b", 0.2), ("a", "c", 0.3), ("a", "a", 0.9)])
    assert stats(s).first().asDict() == pytest.approx({
        "total_topics": 5, "total_instances": 1, "total_edges": 3, "avg_topic_strength": 1.49 / 5,
        "avg_edge_weight": 1.4 / 3, "strong_topics": 1, "weak_topics": 1})
    assert export_stats(s).first()["total_edges"] == 2 == export_edges(s.edges).count()
    assert rows_of(orphans(s.topics, s.edges), "id") == [("e",)]
    ids = spark.createDataFrame([("a",)], "topic_id string")
    assert rows_of(neighbors(s.edges, s.topics, ids), "neighbor_id", "edge_weight") == [("a", 0.9), ("c", 0.3)]
    assert rows_of(export_nodes(s.topics, s.instances).orderBy("id"), "instance_count") == [(1,), (0,), (0,), (0,), (0,)]
    empty = empty_snapshot(spark)
    assert export_stats(empty).first()["avg_topic_strength"] == 0.0
    assert stats(empty).first()["avg_topic_strength"] is None


# --- forgetting ---


def aged(spark, rows):
    return complete(spark.createDataFrame(
        [(i, i, [1.0], s, n) for i, s, n, _ in rows],
        "id string, topic_name string, topic_embedding array<double>, strength double, access_count int").join(
        spark.createDataFrame([(i, d) for i, _, _, d in rows], "id string, last string").select(
            "id", F.col("last").cast("timestamp_ntz").alias("last_accessed")), "id"), "topics", AS_OF)


def test_decay_and_eviction(spark):
    topics = aged(spark, [
        ("week", 0.8, 0, "2024-01-24 00:00:00"), ("old", 0.8, 4, "2023-12-31 00:00:00"),
        ("busy", 0.8, 5, "2023-10-01 00:00:00"), ("edge", 0.001, 0, "2024-01-01 00:00:00"),
        ("gone", 0.5, 4, "2023-12-01 00:00:00")])
    decayed = {r["id"]: r for r in updates.decay_topics(topics, AS_OF).collect()}
    assert decayed["week"]["strength"] == pytest.approx(0.4)
    assert decayed["busy"]["strength"] == 0.01 > decayed["busy"]["decayed_strength"]
    s = make(spark, [], [("i", "gone", "x", [1.0]), ("j", "week", "y", [1.0])],
             [("gone", "week", 0.5), ("week", "gone", 0.5), ("week", "busy", 0.5)]).with_tables(topics=topics)
    after, gone = updates.evict(s, as_of=AS_OF)
    # Idle exactly 30 days is not over 30 days; five accesses are too many.
    assert sorted(rows_of(gone, "id")) == [("gone",), ("old",)]
    assert rows_of(after.instances, "id") == [("j",)] and after.edges.count() == 1
    assert sorted(r[0] for r in rows_of(after.topics, "id")) == ["busy", "edge", "week"]


def test_repeatable_decay(spark):
    topics = aged(spark, [("a", 0.8, 0, "2024-01-17 00:00:00")])
    twice = updates.decay_to(updates.decay_to(topics, "2024-01-24 00:00:00"), AS_OF)
    assert twice.first()["strength"] == pytest.approx(0.2)
    assert updates.decay_to(twice, AS_OF).first()["strength"] == pytest.approx(0.2)


def test_edges_fade(spark):
    edges = make(spark, [], [], [("a", "b", 0.1), ("b", "c", 0.2), ("c", "d", 0.05), ("d", "e", 0.049)]).edges
    edges = edges.withColumn("last_activated", F.when(F.col("from_topic") == "b", F.lit("2024-01-24 00:00:00")).otherwise(
        F.lit("2024-01-30 00:00:00")).cast("timestamp_ntz"))
    idle = {r["from_topic"]: r for r in updates.decay_idle_edges(edges, AS_OF).collect()}
    assert idle["b"]["weight"] == pytest.approx(0.1) and idle["b"]["is_decayed"]
    assert idle["a"]["weight"] == 0.1 and not idle["a"]["is_decayed"]
    assert [w for _, w in sorted(rows_of(updates.fade_edges(edges), "from_topic", "weight"))] == pytest.approx(
        [0.1, 0.19, 0.05, 0.049])
    assert updates.prune_edges(edges).count() == 3


def test_strengthen(spark):
    topics = aged(spark, [("a", 0.95, 1, "2024-01-01 00:00:00"), ("b", 0.2, 0, "2024-01-01 00:00:00")])
    log = spark.createDataFrame([("a", "2024-01-02 00:00:00"), ("a", "2024-01-03 00:00:00")], "topic_id string, at string")
    counts = updates.count_accesses(log.select("topic_id", F.col("at").cast("timestamp_ntz").alias("ts")))
    got = {r["id"]: r for r in updates.strengthen_topics(topics, counts, as_of=AS_OF).collect()}
    assert got["a"]["strength"] == 1.0 and got["a"]["access_count"] == 3
    assert got["a"]["half_life_days"] == pytest.approx(7 * 1.21) and got["a"]["last_accessed"].day == 3
    assert got["b"]["strength"] == 0.2 and got["b"]["half_life_days"] == 7.0


def test_day_expressions(spark):
    frame = spark.createDataFrame([("2024-01-01 12:00:00",), ("2024-03-01 12:00:00",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t"), F.lit(AS_OF).cast("timestamp_ntz").alias("now"))
    got = frame.select(scoring.whole_days(F.col("t"), F.col("now")), scoring.elapsed_days(F.col("t"), F.col("now"))).collect()
    assert [tuple(r) for r in got] == [(29, 29.5), (-30, -30.5)]


def test_vector_expressions(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = frame.select(vectors.cosine_similarity(a, b), vectors.cosine_or_zero(a, b), vectors.l2_distance(a, b),
                       vectors.relevance(a, b), vectors.cosine_distance(a, b)).collect()
    assert [round(x, 9) for x in got[0]] == [0.96, 0.96, round(math.sqrt(2), 9), round(1 - math.sqrt(2) / 2, 9), 0.04]
    assert got[1][0] is None and got[1][1] == 0.0


# --- clustering ---


def test_kmeans_topics(spark):
    words = ["cat", "dog", "ship"]
    triples = triple_frame(spark, [(f"{w}{i}", w, w) for w in words for i in range(4)])

    def embedder(texts):
        return [[float(w in t) for w in words] for t in texts]

    rows = kmeans_topics(triples, embedder, 3).collect()
    assert len(rows) == 12 and {r["topic"] for r in rows} == {"cat0", "dog0", "ship0"}
    assert all(r["instance"].startswith(r["topic"][:3]) for r in rows)
    assert kmeans_topics(triples.limit(0), embedder, 3).count() == 0
    assert kmeans_topics(triples.limit(1), embedder, 3).count() == 1
