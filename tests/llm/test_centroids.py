"""Clustering in whole numbers against Lloyd's rounds without bounds."""

import hashlib
import math

import numpy as np
import pytest

from fadegraph.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, row long, cluster int, vec string"
LONG = 2**63 - 1


def grouped(n=500, width=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = []
    for i in range(n):
        v = centres[0] if i % 3 == 0 else centres[i % 5] + 0.3 * rng.normal(size=width)
        rows.append((i, [float(x) for x in v]))
    return rows


def whole(x, scale):
    return max(-LONG - 1, min(LONG, math.floor(scale * x)))


def model(rows, k, rounds, scale, width):
    kept = [(i, [whole(x, scale) for x in v]) for i, v in rows
            if i is not None and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            members = [v for (_, v), c in zip(kept, own) if c == j]
            if members:
                centres[j] = [sum(col) // len(members) for col in zip(*members)]
    last = [(i, *nearest(v)) for i, v in kept]
    by = {}
    for _, d, j in last:
        by[j] = by.get(j, 0) + d
    total = min(sum(by.values()), LONG)
    return sorted((i, j, min(d, LONG), min(by[j], LONG), total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
                  for i, d, j in last)


def found(spark, rows, **how):
    table = spark.createDataFrame([(i, v, 1, 2, "clash") for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, centroids.cluster_vectors(table, **how).collect()))


def test_clusters(spark):
    rows = grouped()
    rows += [(900, None), (901, []), (902, [1.0]), (903, [None] * 6), (904, [float("nan")] + [0.0] * 5), (None, [1.0] * 6),
             (905, [float("inf")] * 6), (7, rows[7][1]), (7, rows[8][1]), (910, [1.0] * 7)]
    evaluated = []
    assert found(spark, rows, k=8, rounds=10, width=6, report=evaluated) == model(rows, 8, 10, 1024.0, 6)
    assert evaluated[0] == 502 * 8 and sum(evaluated[2:]) < 0.7 * 502 * 8 * len(evaluated[2:])


@pytest.mark.parametrize("rows", [
    [(i, [float(i % 4), 1.0]) for i in range(40)],  # ties
    [(i, [1.0, 1.0]) for i in range(20)],  # empty clusters
    [(0, [1.0, 2.0]), (1, [1.0, 3.0])],  # fewer vectors than clusters
    [(i, [float((i * 7919) % 13) * 10.0 ** (i % 30), -3.0]) for i in range(60)],  # beyond 64 bits
], ids=["ties", "empty clusters", "few", "large"])
def test_odd_vectors(spark, rows):
    assert found(spark, rows, k=8, rounds=10, width=2) == model(rows, 8, 10, 1024.0, 2)


def test_no_vectors(spark):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_bounds_use_the_whole_displacement():
    """A centroid that came back loosens no bound, however far it went in between."""
    x = np.array([[0, 0], [1, 0], [100, 0], [101, 0]], dtype=np.int64)
    there = [[0, 0], [100, 0]]
    away = [[0, 500], [100, 900]]
    seen, stamp = np.zeros((4, 2)), np.zeros((4, 2), dtype=np.int64)
    own, evaluated = centroids.assign(x, np.full(4, -1), seen, stamp, centroids.History([there]))
    assert own.tolist() == [0, 0, 1, 1] and evaluated == 8
    again, evaluated = centroids.assign(x, own, seen, stamp, centroids.History([there, away, there]))
    assert again.tolist() == own.tolist() and evaluated == 0


def test_tables_leave_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    found(spark, grouped(60), k=3, rounds=2, width=6)
    assert {t.name for t in spark.catalog.listTables()} == before
