from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import queries
from fadegraph import SearchConfig, Snapshot
from fadegraph.config import SimilarityLimits
from fadegraph.functions.embed import embed_hashed, embed_with
from fadegraph.functions.vectors import dot, norm
from fadegraph.operators import search as search_operators
from fadegraph.operators.graph import ranked_edges
from fadegraph.operators.ingest import batch_summary, ingest, number_entries, upsert_edges
from fadegraph.operators.identity import repeat_number
from fadegraph.operators.search import search, with_products
from fadegraph.plans.maintain import maintain
from fadegraph.plans.read import recall
from fadegraph.plans.write import relation_texts, remember, semantic_rows
from fadegraph.schema import complete, empty_snapshot, violations
from fadegraph.session import cut_lineage
from tests import models
from tests.conftest import LIMITS, TINY, grouped_vectors

AS_OF = "2024-01-31 00:00:00"
TOPIC_COLUMNS = "id string, topic_name string, topic_embedding array<double>, strength double"
INSTANCE_COLUMNS = "id string, topic_id string, content string, content_embedding array<double>"
EDGE_COLUMNS = "from_topic string, to_topic string, weight double"


def floats(v):
    return [float(x) for x in v]


def make(spark, topics, instances=(), edges=()):
    """topics [(id, vector, strength)]; instances [(id, topic, content, vector)]; edges [(a, b, weight)]."""
    return Snapshot(
        complete(spark.createDataFrame([(t, f"name {t}", floats(v), s) for t, v, s in topics], TOPIC_COLUMNS),
                 "topics", AS_OF),
        complete(spark.createDataFrame([(i, t, c, floats(v)) for i, t, c, v in instances], INSTANCE_COLUMNS),
                 "instances", AS_OF),
        complete(spark.createDataFrame(list(edges), EDGE_COLUMNS), "edges", AS_OF))


@pytest.mark.parametrize("limits,head", [(SimilarityLimits(), 4096), (SimilarityLimits(), 2), (TINY, 2)])
@pytest.mark.parametrize("threshold,link", [(0.75, True), (0.95, True), (0.75, False)])
def test_ingest_equals_one_by_one(spark, rng, limits, head, threshold, link):
    pool = grouped_vectors(rng, 60, spread=0.4)
    topics = {f"t{i:02d}": v for i, v in enumerate(pool[:12])}
    vectors = list(pool[12:]) + [np.zeros(8), pool[20], pool[20]]
    entries = list(enumerate(vectors))
    contents = {i: [f"text {j}" for j in rng.integers(0, 6, size=rng.integers(0, 4))] for i, _ in entries}
    stored = {(t, "text 1") for t in topics}
    resolved, links, added = models.ingest(topics, entries, contents, stored, threshold, link)

    snapshot = make(spark, [(t, v, 1.0) for t, v in topics.items()],
                    [(f"i{n}", t, c, np.ones(8)) for n, (t, c) in enumerate(sorted(stored))],
                    [("t00", "t01", 0.5)])
    rows = [(i, j, c, floats(np.ones(8))) for i, cs in contents.items() for j, c in enumerate(cs)]
    done = ingest(
        snapshot,
        spark.createDataFrame([(i, f"entry {i}", floats(v)) for i, v in entries],
                              "entry_ord long, topic string, topic_embedding array<double>"),
        spark.createDataFrame(rows, "entry_ord long, inst_ord long, content string, content_embedding array<double>"),
        SearchConfig(similarity_threshold=threshold, auto_link=link), AS_OF, limits, head)

    named = {}
    got = {}
    for r in done.resolved.collect():
        if r["is_created"]:
            named[r["topic_id"]] = f"new{r['entry_ord']}"
    for r in done.resolved.collect():
        got[r["entry_ord"]] = (named.get(r["topic_id"], r["topic_id"]), r["is_created"])
    assert got == resolved
    assert {(named.get(r["from_topic"], r["from_topic"]), named[r["to_topic"]]): round(r["weight"], 9)
            for r in done.added_edges.collect()} == {k: round(v, 9) for k, v in links.items()}
    assert sorted((r["entry_ord"], named.get(r["topic_id"], r["topic_id"]), r["content"])
                  for r in done.added_instances.collect()) == sorted(added)
    report = {r["entry_ord"]: (r["is_added"], r["n_added"]) for r in done.report.collect()}
    assert report == {i: (bool(contents[i]), sum(1 for a in added if a[0] == i)) for i, _ in entries}
    after = done.snapshot
    assert after.topics.count() == len(topics) + sum(c for _, c in resolved.values())
    assert after.instances.count() == len(stored) + len(added)
    assert after.edges.count() == 1 + len(links)
    assert all(r["n_rows"] == 0 for r in violations(after).collect())


def test_ingest_boundaries(spark):
    # Similarity exactly 0.9 does not reuse, exactly 0.75 does not link.
    snapshot = make(spark, [("t", [1.0, 0.0, 0.0, 0.0], 1.0)])
    entries = spark.createDataFrame(
        [(1, "nine tenths", [9.0, 19.0 ** 0.5, 0.0, 0.0]), (2, "three quarters", [3.0, 0.0, 7.0 ** 0.5, 0.0])],
        "entry_ord long, topic string, topic_embedding array<double>")
    instances = spark.createDataFrame(
        [(1, 1, "a", [1.0, 0.0, 0.0, 0.0]), (1, 2, "a", [1.0, 0.0, 0.0, 0.0]), (2, 1, "b", [1.0, 0.0, 0.0, 0.0])],
        "entry_ord long, inst_ord long, content string, content_embedding array<double>")
    done = ingest(snapshot, entries, instances, as_of=AS_OF)
    assert [r["is_created"] for r in done.resolved.orderBy("entry_ord").collect()] == [True, True]
    assert [round(r["weight"], 9) for r in done.added_edges.collect()] == [0.9]
    # A repeat inside one entry stays.
    assert done.added_instances.filter("content = 'a'").count() == 2
    again = ingest(done.snapshot, entries, instances, as_of="2024-02-01 00:00:00")
    assert again.added_instances.count() == 0
    assert batch_summary(again.report).first().asDict() == {
        "n_entries": 2, "n_succeeded": 2, "all_succeeded": True}


def test_ids_over_imports_with_one_clock(spark):
    def rows(file, *texts):
        return spark.createDataFrame([(file, topic, i, text) for i, (topic, text) in enumerate(texts)],
                                     "source_file string, topic string, ord long, instance string")

    first = rows("f1", ("red apples", "apples are red"), ("red apples", "apples fall"), ("red apples", "apples fall"), ("!!!", "what"))
    second = rows("f2", ("apples red", "apples are sweet"), ("blue water", "water is wet"), ("!!!", "what"), ("!!!", "else"))
    third = rows("f0", ("red apples", "apples are red"), ("blue water", "water flows"), ("!!!", "what"))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        runs = []
        for partitions in ("2", "8"):  # run again, however rows are dealt, the ids are the same
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            memory = empty_snapshot(spark)
            for batch in (first, second, third, third):
                done = remember(memory, batch, lambda df, col, out: embed_hashed(df, col, 64, out), as_of=AS_OF)
                memory = Snapshot(*(cut_lineage(t) for t in (done.snapshot.topics, done.snapshot.instances, done.snapshot.edges)))
                assert all(r["n_rows"] == 0 for r in violations(memory).collect())
            runs.append(sorted((r["id"], r["topic_id"], r["content"]) for r in memory.instances.collect()))
        names = {r["id"]: r["topic_name"] for r in memory.topics.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert runs[0] == runs[1]
    # A topic without direction is never found again, so each import makes one of its own.
    assert sorted(names.values()) == ["!!!"] * 4 + ["blue water", "red apples"]
    assert sorted((names[t], c) for _, t, c in runs[0]) == sorted(
        [("red apples", "apples are red"), ("red apples", "apples fall"), ("red apples", "apples fall"), ("red apples", "apples are sweet"),
         ("blue water", "water is wet"), ("blue water", "water flows")] + [("!!!", "what")] * 4 + [("!!!", "else")])


def test_imported_texts_are_derived_once(spark):
    derived = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            derived.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([(0, 0, "a", [1.0, 0.0]), (1, 1, "b", [0.0, 1.0])],
                                  "entry_ord long, inst_ord long, content string, content_embedding array<double>")
    snapshot = make(spark, [("t1", [1.0, 0.0], 1.0)], [("i1", "t1", "a", [1.0, 0.0])], [("t1", "t1", 0.5)])
    entries = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "y", [0.0, 1.0])], "entry_ord long, topic string, topic_embedding array<double>")
    given = SimpleNamespace(snapshot=snapshot, instances=snapshot.instances, ingest_entries=entries,
                            ingest_instances=texts.mapInArrow(count, texts.schema))
    after = queries._import_twice(given)[0]
    assert sorted(r[0] for r in after.instances.select("content").collect()) == ["a", "b", "b again"]
    assert derived.value == 2


def test_an_id_is_free_after_its_row_moved(spark):
    stored = make(spark, [("t", [1.0, 0.0], 1.0)])
    entries = spark.createDataFrame([(1, "here", [1.0, 0.0])], "entry_ord long, topic string, topic_embedding array<double>")
    texts = spark.createDataFrame([(1, 1, "a", [1.0, 0.0]), (1, 2, "a", [1.0, 0.0])],
                                  "entry_ord long, inst_ord long, content string, content_embedding array<double>")
    once = ingest(stored, entries, texts, as_of=AS_OF).snapshot
    moved = once.with_tables(topics=once.topics.unionByName(once.topics.withColumn("id", F.lit("u")).withColumn(
        "topic_embedding", F.array(F.lit(0.0), F.lit(1.0)))), instances=cut_lineage(once.instances.withColumn("topic_id", F.lit("u"))))
    again = ingest(moved, entries, texts, as_of=AS_OF).snapshot
    assert again.instances.count() == 4 and all(r["n_rows"] == 0 for r in violations(again).collect())


def test_repeats_are_numbered_in_blocks(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 57), ("b", 3), (None, 0)) for i in range(0, 3 * n, 3)], "key string, place long")
    got = repeat_number(rows, ["key"], "place", block=10).collect()
    assert sorted((r["key"], r["place"], r["repeat_no"]) for r in got) == [(k, 3 * i, i) for k, n in (("a", 57), ("b", 3)) for i in range(n)]


def test_upsert_keeps_the_larger_weight(spark):
    edges = make(spark, [], [], [("a", "b", 0.5), ("b", "c", 0.9)]).edges
    offers = spark.createDataFrame([("a", "b", 0.7), ("a", "b", 0.6), ("b", "c", 0.1), ("c", "a", 0.3)], EDGE_COLUMNS)
    got = {(r["from_topic"], r["to_topic"]): r["weight"] for r in upsert_edges(edges, offers, AS_OF).collect()}
    assert got == {("a", "b"): 0.7, ("b", "c"): 0.9, ("c", "a"): 0.3}


def graph_fixture(rng, n=40):
    vectors = grouped_vectors(rng, n, spread=0.3)
    topics = {f"t{i:02d}": (vectors[i], float(rng.integers(20, 100)) / 100) for i in range(n)}
    edges = {}
    for a, b, w in rng.integers(0, [n, n, 100], size=(260, 3)).tolist():
        edges[(f"t{a % 12 if w % 3 else a:02d}", f"t{b:02d}")] = (w + 1) / 100
    return topics, edges


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("rate", [0.0, 0.5])
def test_search_equals_the_queue(spark, rng, limits, rate):
    topics, edges = graph_fixture(rng)
    asked = {f"q{i}": v for i, v in enumerate(grouped_vectors(rng, 8))}
    snapshot = make(spark, [(t, v, s) for t, (v, s) in topics.items()], [], [(a, b, w) for (a, b), w in edges.items()])
    queries = spark.createDataFrame([(q, floats(v)) for q, v in asked.items()],
                                    "query_id string, query_embedding array<double>")
    config = SearchConfig(dropout_rate=rate)
    dropped = {(r["from_topic"], r["to_topic"]) for r in ranked_edges(snapshot.edges, config).filter("is_dropped").collect()}
    assert bool(dropped) == bool(rate)
    scored, traversed = search(queries, snapshot.topics, snapshot.edges, config, limits)
    got = {}
    for r in scored.orderBy("query_id", "depth", "path").collect():
        got.setdefault(r["query_id"], []).append((r["topic_id"], r["depth"], round(r["path_strength"], 9), round(r["score"], 9)))
    walked = {}
    for q, v in asked.items():
        visited, order, edges_used = models.bfs(v, topics, edges, dropped=dropped)
        assert got[q] == [(t, visited[t][0], round(visited[t][1], 9), round(visited[t][2], 9)) for t in order]
        for e in edges_used:
            walked[e] = walked.get(e, 0) + 1
    assert {(r["from_topic"], r["to_topic"]): r["n_traversals"] for r in traversed.collect()} == walked


def test_visits_meet_vectors_in_blocks(spark, rng, monkeypatch):
    monkeypatch.setattr(search_operators, "_VISIT_ROWS", 40)
    vectors = [*map(floats, rng.normal(size=(20, 3))), [0.0, 0.0, 0.0], [1.0, 2.0], [1.0, None, 2.0], None, [float("nan"), 1.0, 1.0]]
    topics = spark.createDataFrame([(f"t{i % 24}", v, i / 10) for i, v in enumerate(vectors)], "topic_id string, vec array<double>, strength double")
    asked = spark.createDataFrame([(f"q{i % 23}", v) for i, v in enumerate(vectors)], "query_id string, vec array<double>")
    visits = [(f"q{q}", f"t{t}", [q, t]) for q in range(26) for t in range(25) if (q + t) % 3] + [(None, "t1", [0]), ("q1", None, [0])]
    visited = spark.createDataFrame(visits, "query_id string, topic_id string, path array<int>")
    both = visited.join(topics.withColumnRenamed("vec", "a"), "topic_id").join(asked.withColumnRenamed("vec", "b"), "query_id")
    want = both.select("query_id", "topic_id", "path", "strength", dot(F.col("a"), F.col("b")).alias("product"), norm(F.col("a")).alias("n1"),
                       norm(F.col("b")).alias("n2")).collect()
    normed = lambda rows, out: rows.withColumn(out, norm(F.col("vec")))
    got = with_products(visited, normed(topics, "n1"), normed(asked, "n2")).select(
        "query_id", "topic_id", "path", "strength", "product", "n1", "n2").collect()

    def plain(rows):  # a product counts where both norms are known
        return sorted(repr((*r[:4], None if r["n1"] is None or r["n2"] is None else r["product"], r["n1"], r["n2"])) for r in rows)

    assert plain(got) == plain(want) and len(got) > 300


def test_a_visit_carries_no_vector(spark, rng):
    topics, edges = graph_fixture(rng)
    snapshot = make(spark, [(t, v, s) for t, (v, s) in topics.items()], [], [(a, b, w) for (a, b), w in edges.items()])
    queries = spark.createDataFrame([("q", floats(topics["t05"][0]))], "query_id string, query_embedding array<double>")
    scored = search(queries, snapshot.topics, snapshot.edges)[0]
    # Joined one after the other, the rows of the visits would be shuffled with a topic's vector each.
    assert "Join" not in scored._jdf.queryExecution().executedPlan().toString()


def test_first_arrival_sets_the_strength_and_depth_is_bounded(spark):
    # a -> b -> d arrives before c -> d although c's path is stronger; the chain runs on beyond depth 5.
    vector = [1.0, 0.0]
    ids = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
    far = [0.0, 1.0]
    topics = [(t, vector if t == "a" else far, 1.0) for t in ids]
    edges = [("a", "b", 0.9), ("a", "c", 0.8), ("b", "d", 0.5), ("c", "d", 0.9), ("d", "e", 1.0), ("e", "f", 1.0),
             ("f", "g", 1.0), ("g", "h", 1.0), ("h", "i", 1.0), ("a", "i", 0.1999), ("i", "h", 0.2)]
    snapshot = make(spark, topics, [], edges)
    queries = spark.createDataFrame([("q", vector)], "query_id string, query_embedding array<double>")
    # Only a is an entry point that matters: b and c tie with the rest and come next by id.
    scored, traversed = search(queries, snapshot.topics, snapshot.edges, SearchConfig(dropout_rate=0.0))
    depth = {r["topic_id"]: r["depth"] for r in scored.collect()}
    model, order, used = models.bfs(vector, {t: (v, s) for t, v, s in topics}, {(a, b): w for a, b, w in edges})
    assert depth == {t: d for t, (d, _, _) in model.items()}
    assert {(r["from_topic"], r["to_topic"]) for r in traversed.collect()} == set(used)


def test_recall_effects_and_results(spark, rng):
    topics, edges = graph_fixture(rng)
    instances = [(f"i{n:03d}", f"t{n % 25:02d}", f"text {n}", grouped_vectors(rng, 1)[0]) for n in range(300)]
    snapshot = make(spark, [(t, v, s) for t, (v, s) in topics.items()], instances,
                    [(a, b, w) for (a, b), w in edges.items()])
    query = topics["t05"][0]
    queries = spark.createDataFrame([("q", floats(query))], "query_id string, query_embedding array<double>")
    config = SearchConfig(dropout_rate=0.0)
    done = recall(snapshot, queries, config, as_of=AS_OF)
    visited, order, used = models.bfs(query, topics, edges)
    ranked = sorted((t for t in order if visited[t][2] > 0.25), key=lambda t: -visited[t][2])[:5]
    assert ranked
    filled = [t for t in ranked if any(i[1] == t for i in instances)]
    got = done.results.orderBy("rank").collect()
    assert [r["topic_id"] for r in got] == filled
    for r in got:
        best = sorted((i for i in instances if i[1] == r["topic_id"]),
                      key=lambda i: (-models.cosine(query, i[3]), i[0]))[:10]
        assert r["contents"] == [i[2] for i in best]
    after = {r["id"]: r for r in done.snapshot.topics.collect()}
    for t, (_, strength) in topics.items():
        gain = (0.05 if t in visited else 0.0) + (0.1 if t in ranked else 0.0)
        assert after[t]["strength"] == pytest.approx(min(1.0, strength + gain))
        assert after[t]["access_count"] == (1 if t in ranked else 0)
    weights = {(r["from_topic"], r["to_topic"]): r["weight"] for r in done.snapshot.edges.collect()}
    assert all(weights[e] == pytest.approx(min(1.0, w + (0.02 if e in used else 0.0))) for e, w in edges.items())
    assert recall(snapshot, queries, config, limit=1, as_of=AS_OF).results.count() == min(1, len(filled))


def hashed(df, column, out):
    return embed_hashed(df, column, 64, out)


def test_remember_twice_adds_nothing_new(spark):
    rows = spark.createDataFrame([
        ("f1", "red apples", 0, "apples are red"), ("f1", "red apples", 1, "apples grow on trees"),
        ("f1", "blue water", 5, "water is blue"), ("f2", "apples red", 0, "apples are red")],
        "source_file string, topic string, ord long, instance string")
    first = remember(empty_snapshot(spark), rows, hashed, as_of=AS_OF)
    assert sorted(r["topic_name"] for r in first.snapshot.topics.collect()) == ["blue water", "red apples"]
    # The second file's topic is the same bag of words, and its text is known.
    assert first.added_instances.count() == 3
    assert remember(first.snapshot, rows, hashed, as_of=AS_OF).added_instances.count() == 0


def test_entries_are_numbered_in_order(spark):
    rows = spark.createDataFrame([("f2", "b", 0, "x"), ("f1", "z", 3, "x"), ("f1", "a", 9, "x"), ("f1", "z", 1, "y")],
                                 "source_file string, topic string, ord long, instance string")
    got = number_entries(rows).orderBy("entry_ord", "ord").collect()
    assert [(r["source_file"], r["topic"], r["ord"]) for r in got] == [
        ("f1", "z", 1), ("f1", "z", 3), ("f1", "a", 9), ("f2", "b", 0)]


def test_semantic_rows(spark):
    triples = spark.createDataFrame([
        ("f", 0, "cats", "chase", "mice"), ("f", 1, "cats", "chase", "mice "), ("f", 2, "cats", "chase", "mice often"),
        ("f", 3, "ships", "cross", "oceans")], "source_file string, triple_ord long, subject string, relation string, object string")
    rows = semantic_rows(relation_texts(triples), hashed, 0.7, 1).orderBy("cluster", "ord").collect()
    assert [r["instance"] for r in rows] == ["cats chase mice", "cats chase mice often", "ships cross oceans"]
    assert {r["topic"] for r in rows} == {"cats chase mice", "ships cross oceans"} or {
        r["topic"] for r in rows} == {"cats chase mice often", "ships cross oceans"}
    assert semantic_rows(relation_texts(triples), hashed, 0.7, 2).count() == 2


def test_embed_with_a_callable(spark):
    rows = spark.createDataFrame([("ab",), ("abc",)], "text string")
    got = embed_with(rows, "text", lambda texts: [[len(t), 1.0] for t in texts]).collect()
    assert [r["embedding"] for r in got] == [[2.0, 1.0], [3.0, 1.0]]
    with pytest.raises(ValueError):
        embed_with(rows, "text", None)


def test_maintain(spark, rng):
    vectors = grouped_vectors(rng, 20, spread=0.2)
    topics = [(f"t{i:02d}", vectors[i], 0.05 if i == 19 else 0.8) for i in range(20)]
    instances = [(f"i{i:02d}", f"t{i % 12:02d}", f"content number {i} with a tail", vectors[i % 3]) for i in range(20)]
    edges = [("t00", "t01", 0.5), ("t01", "t02", 0.1), ("t02", "t03", 0.04)] + [
        (f"t{i:02d}", "t00", 0.3) for i in range(4, 19)]
    before = make(spark, topics, instances, edges)
    after = maintain(before, AS_OF)
    assert all(r["n_rows"] == 0 for r in violations(after).collect())
    weights = {(r["from_topic"], r["to_topic"]): r["weight"] for r in after.edges.collect()}
    assert all(w != 0.04 for w in weights.values())
    assert after.instances.count() == 20
    assert "t19" not in {r["id"] for r in after.topics.collect()}
    names = [r["topic_name"] for r in after.topics.collect()]
    assert any(n.startswith("[INFO] Automatically discovered: content number") for n in names)


def test_hot_topic_is_many_blocks(spark, rng):
    """A topic with most instances is ranked in blocks, to the same end."""
    from fadegraph.operators.search import top_instances

    vecs = rng.normal(size=(90, 4))
    instances = spark.createDataFrame(
        [(f"i{n:03d}", "hot" if n % 3 else f"t{n % 5}", f"text {n}", floats(v), float(n % 7) / 7, float(n % 4) / 4) for n, v in enumerate(vecs)],
        "id string, topic_id string, content string, content_embedding array<float>, relevance_score double, importance double")
    chosen = spark.createDataFrame([("q1", "hot", 1), ("q1", "t0", 2), ("q2", "hot", 1), ("q2", "gone", 2)],
                                   "query_id string, topic_id string, rank int")
    queries = spark.createDataFrame([("q1", floats(vecs[0])), ("q2", floats(vecs[1]))], "query_id string, query_embedding array<float>")
    few = top_instances(chosen, queries, instances, 4, block_rows=5)
    assert sorted(map(str, few.collect())) == sorted(map(str, top_instances(chosen, queries, instances, 4).collect()))
    assert {r["topic_id"] for r in few.collect()} == {"hot", "t0"}
    plan = few._jdf.queryExecution().executedPlan().toString()
    # Texts are joined after the last ranking, which has an exchange of its own.
    assert plan.index("content#") < plan.rindex("Window")
    assert "_block" in plan


def test_leaders_exchange_before_the_single_task(spark):
    from fadegraph.operators import leaders
    from fadegraph.operators import vector_blocks as vb

    rows = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(5)], "n long, v array<float>")
    points = vb.side(rows, F.col("n"), "v", ord_=F.col("n"))
    plan = leaders._lead_in_order(points.filter(F.col("ord") <= 3), 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "Exchange" in plan


def test_rows_of_visits_and_vectors_hold_no_null_lists(spark):
    from fadegraph.operators.search import stacked

    visits = spark.createDataFrame([("q", "t", [1, 2])], "query_id string, topic_id string, path array<int>")
    topics = spark.createDataFrame([("t", [0.5])], "topic_id string, vec array<double>")
    queries = spark.createDataFrame([("q", [2.0])], "query_id string, vec array<double>")
    rows = stacked([visits, topics, queries]).collect()
    assert [(r["path"], r["vec"]) for r in rows] == [([1, 2], []), ([], [0.5]), ([], [2.0])]


def test_texts_are_not_shuffled_to_number_their_entries(spark):
    from fadegraph.operators.ingest import number_entries

    rows = spark.createDataFrame([("f", "b", 0, "x"), ("f", "a", 1, "y"), ("f", "b", 2, "z"), ("f", None, 3, "w")],
                                 "source_file string, topic string, ord long, instance string")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, -1)
    try:
        numbered = number_entries(rows)
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        found = sorted((r["entry_ord"], r["instance"]) for r in numbered.collect())
    finally:
        spark.conf.set(setting, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [text for _, text in found] == ["x", "z", "y"] and found[0][0] == found[1][0] < found[2][0]
