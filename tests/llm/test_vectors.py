"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fadegraph.llm import covertree, hashforest

SCHEMA = "vec_id long, embedding array<float>, h1 string, keys int"


def asks():
    return F.col("vec_id") % 50 == 0


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12))
    out = []
    for i in range(600):
        v = centres[i % 8] * 0.6 + rng.normal(size=12) * 0.5
        if i % 3 == 0:
            v = centres[0]  # a third are one vector
        out.append((i, np.asarray(v, np.float32).tolist(), "clash", 1))
    out += [(700, None, "", 0), (750, [], "", 0), (800, [1.0, None] + [0.0] * 10, "", 0), (850, [float("nan")] * 12, "", 0),
            (900, [float("inf")] + [0.0] * 11, "", 0), (950, [0.0] * 12, "", 0), (1_000, [0.5, 0.25, -1.0], "", 0),
            (1_001, [0.5, 0.5, 1.0], "", 0), (None, [1.0] * 12, "", 0), (5, out[5][1], "", 0), (50, out[50][1], "", 0)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def usable(rows, zero):
    kept = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        kept[i] = np.array(v)
    return kept


@pytest.mark.parametrize("block", [4_096, 40])
def test_exact_products(table, rows, block, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK_ROWS", block)
    kept = {i: [math.floor(256 * float(x)) for x in v] for i, v in usable(rows, True).items()}
    want = set()
    for q in kept:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(kept[q], v)), i) for i, v in kept.items() if i != q and len(v) == len(kept[q]))
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])}
    assert set(map(tuple, covertree.top_k(table, asks()).collect())) == want


def test_products_beyond_double_precision(spark):
    big = [(0, [3e7, 1.0]), (1, [3e7, 0.0]), (2, [3e7, 1 / 256]), (3, [-3e7, 1.0]), (4, [1e30, 0.0])]
    table = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    ints = {i: [min(math.floor(256 * x), 2**63 - 1) for x in v] for i, v in big}
    want = sorted(((-min(sum(a * b for a, b in zip(ints[0], ints[i])), 2**63 - 1), i) for i in ints if i != 0))
    got = covertree.top_k(table, F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for _, i in want[:3]]
    assert [r.score for r in got][1:] == [-s for s, _ in want[1:3]]


def test_cover_tree_bounds():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-300, 300, size=(500, 6)).astype(float), rng.integers(-300, 300, size=(90, 6)).astype(float)

    def walk(node):
        assert np.linalg.norm(x[node.points] - node.centre, axis=1).max() <= node.radius + 1e-9
        assert not node.children or sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
        for child in node.children:
            walk(child)

    tree, asked = covertree.cover_tree(x), covertree.cover_tree(q)
    walk(tree)
    for a in asked.children or [asked]:
        for b in tree.children:
            assert (q[a.points] @ x[b.points].T).max() <= covertree._bound(a, b)


@pytest.mark.parametrize("block", [4_096, 60])
def test_forest_finds_nearest(table, rows, block, monkeypatch):
    monkeypatch.setattr(hashforest, "BLOCK_ROWS", block)
    kept = usable(rows, False)
    found = {(r.query_id, r.vec_id): r for r in hashforest.nearest(table, asks()).collect()}
    hits = total = 0
    for q in kept:
        if q % 50:
            continue
        scores = sorted((-float(kept[q] @ v / np.sqrt((kept[q] @ kept[q]) * (v @ v))), i) for i, v in kept.items()
                        if i != q and len(v) == len(kept[q]))
        own = [r for (a, _), r in found.items() if a == q]
        assert len(own) == min(5, len(scores)) and sorted(r["rank"] for r in own) == list(range(1, len(own) + 1))
        for s, i in scores[:5]:
            total += 1
            hits += (q, i) in found
            if (q, i) in found:
                assert abs(found[q, i].score + s) < 1e-12
        if q == 0:  # one of a third: the copies of the smallest ids, in order
            assert [r.vec_id for r in sorted(own, key=lambda r: r["rank"])] == [3, 6, 9, 12, 15]
    assert hits >= 0.9 * total


def test_forest_ascends_as_far_as_it_must(table, rows):
    kept = usable(rows, False)
    all_rows = hashforest.nearest(table, asks(), candidates=10**9).collect()
    for r in all_rows:
        others = sorted((-float(kept[r.query_id] @ v / np.sqrt((kept[r.query_id] @ kept[r.query_id]) * (v @ v))), i)
                        for i, v in kept.items() if i != r.query_id and len(v) == len(kept[r.query_id]))
        assert abs(r.score + others[r["rank"] - 1][0]) < 1e-12


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert covertree.top_k(none, asks()).collect() == [] and hashforest.nearest(none, asks()).collect() == []
    alone = spark.createDataFrame([(50, [1.0, 2.0], "", 0)], SCHEMA)
    assert covertree.top_k(alone, asks()).collect() == [] and hashforest.nearest(alone, asks()).collect() == []
