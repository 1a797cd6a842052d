import pytest
from tests.conftest import LIMITS, TINY, grouped_vectors
from tests import models
from pyspark.sql import functions as F

from fadegraph.operators.components import connected_components, forest_roots
from fadegraph.operators.density import dbscan
from fadegraph.operators.merge import apply_merge, merge_plan, merge_targets
from fadegraph.schema import EDGES, INSTANCES, TOPICS, Snapshot, complete

AS_OF = "2024-01-31 00:00:00"


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("eps,spread", [(0.3, 0.45), (0.1, 0.3), (0.3, 0.8)])
def test_dbscan(spark, rng, limits, eps, spread):
    vectors = grouped_vectors(rng, 80, width=5, spread=spread)
    vectors[50:70] = vectors[50]
    points = {f"p{i:03d}": v for i, v in enumerate(vectors)}
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in points.items()], "id string, v array<double>")
    got = {r["id"]: (r["is_core"], r["cluster"]) for r in dbscan(rows, "id", "v", eps, 5, limits).collect()}
    assert got == models.dbscan(points, eps, 5)


def test_dbscan_border_and_noise(spark):
    # Angles in degrees: two groups, one point between them, one far away.
    import math

    angles = [0, 1, 2, 3, 4, 40, 80, 81, 82, 83, 84, 170]
    rows = [(f"p{i:02d}", [math.cos(math.radians(a)), math.sin(math.radians(a))]) for i, a in enumerate(angles)]
    frame = spark.createDataFrame(rows, "id string, v array<double>")
    got = {r["id"]: (r["is_core"], r["cluster"]) for r in dbscan(frame, "id", "v", 0.24, 5).collect()}
    assert got == models.dbscan(dict(rows), 0.24, 5)
    assert got["p11"] == (False, None)


@pytest.mark.parametrize("bound", [10_000, 0])
def test_components(spark, rng, bound):
    pairs = [(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, 120, size=(80, 2)).tolist()]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("x", "x")]
    home = {}
    for a, b in pairs:
        home.setdefault(a, {a})
        home.setdefault(b, {b})
        joined = home[a] | home[b]
        for n in joined:
            home[n] = joined
    got = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(pairs, "a string, b string"), bound).collect()}
    assert got == {n: min(g) for n, g in home.items()}


@pytest.mark.parametrize("bound", [16, None])
def test_forest_roots(spark, bound):
    parents = [(f"n{i:02d}", f"n{i - 1:02d}") for i in range(1, 16)]
    roots = forest_roots(spark.createDataFrame(parents, "node string, parent string"), bound).collect()
    assert {r["root"] for r in roots} == {"n00"} and len(roots) == 15


@pytest.mark.parametrize("pairs", [
    [("1", "2"), ("2", "3")], [("2", "3"), ("1", "2")], [("2", "3"), ("1", "3")], [("1", "3"), ("2", "3"), ("1", "2")]])
@pytest.mark.parametrize("cap", [10, None])
def test_stale_pairs(spark, pairs, cap):
    rows = [(i + 1, a, b) for i, (a, b) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "rank int, id1 string, id2 string")
    got = {r["merged_id"]: r["kept_id"] for r in merge_targets(frame, cap).collect()}
    assert got == models.merge(pairs)


@pytest.mark.parametrize("limits", LIMITS)
def test_merge_plan(spark, rng, limits):
    vectors = {f"t{i:03d}": v for i, v in enumerate(grouped_vectors(rng, 40))}
    topics = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()],
                                   "id string, topic_embedding array<double>")
    ids = sorted(vectors)
    ranked = sorted((-models.cosine(vectors[a], vectors[b]), a, b) for a in ids for b in ids
                    if a < b and models.cosine(vectors[a], vectors[b]) > 0.9)
    for cap in (10, None):
        pairs = [(a, b) for _, a, b in ranked[:cap]]
        got = {r["merged_id"]: r["kept_id"] for r in merge_plan(topics, 0.9, cap, limits).collect()}
        assert got == models.merge(pairs)


def snapshot(spark):
    topics = complete(spark.createDataFrame(
        [(t, t, [1.0, 0.0]) for t in "abcd"], "id string, topic_name string, topic_embedding array<double>"),
        "topics", AS_OF)
    instances = complete(spark.createDataFrame(
        [("i1", "a", "x", [1.0]), ("i2", "b", "y", [1.0]), ("i3", "d", "z", [1.0])],
        "id string, topic_id string, content string, content_embedding array<double>"), "instances", AS_OF)
    edges = complete(spark.createDataFrame(
        [("a", "c", 0.4, 1), ("b", "c", 0.6, 2), ("a", "b", 0.3, 4), ("c", "d", 0.9, 8)],
        "from_topic string, to_topic string, weight double, activation_count int"), "edges", AS_OF)
    return Snapshot(topics, instances, edges)


def test_apply_merge_folds_edges(spark):
    targets = spark.createDataFrame([("b", "a")], "merged_id string, kept_id string")
    after = apply_merge(snapshot(spark), targets)
    assert {(r["id"], r["topic_id"]) for r in after.instances.collect()} == {("i1", "a"), ("i2", "a"), ("i3", "d")}
    assert {(r["from_topic"], r["to_topic"], r["weight"], r["activation_count"]) for r in after.edges.collect()} == {
        ("a", "c", 0.6, 3), ("a", "a", 0.3, 4), ("c", "d", 0.9, 8)}
    assert sorted(r["id"] for r in after.topics.collect()) == ["a", "c", "d"]
    assert after.edges.columns == EDGES.names and after.instances.columns == INSTANCES.names
    assert after.topics.columns == TOPICS.names
    assert apply_merge(snapshot(spark), targets, drop_self_loops=True).edges.count() == 2
