import numpy as np
import pytest
from tests.conftest import LIMITS, TINY, grouped_vectors
from tests.models import cosine
from pyspark.sql import functions as F

from fadegraph.config import SimilarityLimits
from fadegraph.operators import vector_blocks as vb
from fadegraph.operators.leaders import choose_leaders
from fadegraph.operators.similarity import (
    _top_of_block, best_pairs_kernel, follower_kernel, nearest, nearest_lower, similar_pairs)


def frame(spark, vectors, prefix="r", start=0):
    rows = [(f"{prefix}{i + start:04d}", i + start, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return vb.side(spark.createDataFrame(rows, "name string, n long, vector array<double>"), "name", "vector",
                   ord_=F.col("n"))


def brute(left, right, k, floor=None, earlier=False):
    out = {}
    for i, a in enumerate(left):
        found = [(-cosine(a, b), j) for j, b in enumerate(right)
                 if (floor is None or cosine(a, b) > floor) and (not earlier or j < i)]
        out[f"l{i:04d}"] = [(f"r{j:04d}", rank + 1) for rank, (_, j) in enumerate(sorted(found)[:k])]
    return {key: v for key, v in out.items() if v}


def collect(matches):
    out = {}
    for row in matches.orderBy("l_id", "rank").collect():
        out.setdefault(row["l_id"], []).append((row["r_id"], row["rank"]))
    return out


# Stream: the right side is too large to broadcast, the left one is not.
STREAM = SimilarityLimits(broadcast_rows=50, block_rows=7, max_cells=6)


@pytest.mark.parametrize("limits,n_left", [(SimilarityLimits(), 40), (STREAM, 40), (TINY, 40)])
@pytest.mark.parametrize("k,floor,earlier", [(1, None, False), (3, None, False), (3, 0.8, False), (2, 0.7, True)])
def test_nearest(spark, rng, limits, n_left, k, floor, earlier):
    right = grouped_vectors(rng, 90)
    left = np.vstack([right[: n_left // 2], grouped_vectors(rng, n_left // 2)])
    found = nearest(frame(spark, left, "l"), frame(spark, right), k, floor, earlier, limits)
    assert collect(found) == brute(left, right, k, floor, earlier)


def test_nearest_of_spread_vectors_needs_all_cells(spark, rng):
    right, left = rng.normal(size=(80, 16)), rng.normal(size=(30, 16))
    found = nearest(frame(spark, left, "l"), frame(spark, right), 3, limits=TINY)
    assert collect(found) == brute(left, right, 3)


def test_one_vector_holds_a_third_of_the_rows(spark, rng):
    right = grouped_vectors(rng, 90)
    right[30:60] = right[30]
    left = np.vstack([right[25:35], grouped_vectors(rng, 10)])
    found = nearest(frame(spark, left, "l"), frame(spark, right), 3, limits=TINY)
    assert collect(found) == brute(left, right, 3)


def test_vectors_without_direction_match_nothing(spark):
    rows = frame(spark, [[0.0, 0.0], [1.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]])
    assert [r["id"] for r in rows.collect()] == ["r0001"]
    found = nearest(frame(spark, [[0.0, 0.0], [1.0, 1.0]], "l"), rows, 2).collect()
    assert [(r["l_id"], r["r_id"]) for r in found] == [("l0001", "r0001")]


@pytest.mark.parametrize("limits", LIMITS)
def test_similar_pairs(spark, rng, limits):
    vectors = grouped_vectors(rng, 60)
    vectors[20:40] = vectors[20]
    for limit in (10, 25):
        pairs = similar_pairs(frame(spark, vectors), 0.8, limit, limits).orderBy("rank").collect()
        every = sorted((-cosine(vectors[i], vectors[j]), i, j) for i in range(60) for j in range(i + 1, 60)
                       if cosine(vectors[i], vectors[j]) > 0.8)[:limit]
        assert [(p["id1"], p["id2"]) for p in pairs] == [(f"r{i:04d}", f"r{j:04d}") for _, i, j in every]
        assert [p["rank"] for p in pairs] == list(range(1, len(every) + 1))


def test_threshold_is_strict(spark):
    rows = frame(spark, [[1.0, 0.0], [3.0, 4.0]])
    assert similar_pairs(rows, 0.6).count() == 0
    assert similar_pairs(rows, 0.5999).count() == 1


@pytest.mark.parametrize("limits", LIMITS)
def test_nearest_lower(spark, rng, limits):
    vectors = grouped_vectors(rng, 50)
    vectors[10:25] = vectors[10]
    vectors[40] = 2 * vectors[10]
    got = {r["id2"]: r["id1"] for r in nearest_lower(frame(spark, vectors), 0.8, limits).collect()}
    want = {}
    for j in range(50):
        found = sorted((-cosine(vectors[i], vectors[j]), i) for i in range(j) if cosine(vectors[i], vectors[j]) > 0.8)
        if found:
            want[f"r{j:04d}"] = f"r{found[0][1]:04d}"
    assert got == want


@pytest.mark.parametrize("limits,head", [(SimilarityLimits(), 4096), (SimilarityLimits(), 3), (TINY, 3), (TINY, 1)])
def test_leaders(spark, rng, limits, head):
    vectors = grouped_vectors(rng, 70, spread=0.35)
    vectors[30:50] = vectors[30]
    leaders = []
    for i, v in enumerate(vectors):
        if not any(cosine(v, vectors[j]) > 0.85 for j in leaders):
            leaders.append(i)
    found = choose_leaders(frame(spark, vectors), 0.85, limits, head)
    assert sorted(r["ord"] for r in found.select("ord").collect()) == leaders


def test_leaders_of_nothing(spark):
    assert choose_leaders(frame(spark, [[0.0, 0.0]]), 0.9).count() == 0


@pytest.mark.parametrize("n_copies", [0, 200])
def test_rows_are_sent_to_few_blocks(spark, rng, n_copies):
    vectors = rng.normal(size=(400, 6))
    vectors[:n_copies] = vectors[0]
    rows = frame(spark, vectors)

    def kernel(a, b):
        return vb.result_batch("sent double, pairs double", [float(len(a) + len(b))], [float(len(a) * len(b))])

    met = vb.compare(rows, rows, kernel, "sent double, pairs double", -1.0, TINY).agg(F.sum("sent"), F.sum("pairs")).first()
    assert met[1] == 400 * 400
    # Each side goes to as many blocks as the other has; in blocks of 7 rows it would be 58.
    assert met[0] <= 400 * 14


def test_visitors_of_one_cell_are_sent_with_the_base_once(spark, rng):
    rows = frame(spark, rng.normal(size=(400, 6)))
    limits = SimilarityLimits(broadcast_rows=8, block_rows=7, max_cells=64)

    def kernel(a, b):
        return vb.result_batch("sent double, pairs double", [float(len(a) + len(b))], [float(len(a) * len(b))])

    placed, cells = vb.partition_base(rows, limits)
    home = vb.visit_cells(rows, cells, None)
    sent, pairs = vb.against_cells(home, placed, cells, kernel, "sent double, pairs double", limits).agg(
        F.sum("sent"), F.sum("pairs")).first()
    assert pairs >= (cells.counts ** 2).sum()
    # With four blocks to a side the base alone would be sent four times.
    assert sent <= 3 * 400


def test_cells_are_packed_into_blocks():
    first, parts = vb._pack_cells([3, 30, 0, 4, 5, 25, 6], 10)
    held = {}
    for cell, (at, n) in enumerate(zip(first.tolist(), parts.tolist())):
        for block in range(at, at + n):
            held.setdefault(block, []).append(cell)
    assert sorted(c for cells in held.values() for c in cells) == [0, 1, 1, 1, 2, 3, 4, 5, 5, 5, 6]
    assert all(len(cells) == 1 for cells in held.values() if cells[0] in (1, 5))


@pytest.mark.parametrize("n_copies", [0, 200])
def test_a_set_is_sent_once_to_the_blocks_it_meets(spark, rng, n_copies):
    vectors = rng.normal(size=(400, 6))
    vectors[:n_copies] = vectors[0]

    def kernel(a, b):
        return vb.result_batch("sent double, pairs double", [float(len(a) + (len(b) if a.id[0] != b.id[0] else 0))], [float(len(a) * len(b))])

    def met(across):
        found = vb.compare_within(frame(spark, vectors), kernel, "sent double, pairs double", -1.0, TINY, across)
        return found.agg(F.sum("sent"), F.sum("pairs")).first()

    sent, pairs = met(None)
    assert pairs == 400 * 400
    one_way = met(kernel)
    # One way round a pair of blocks is met once; ``compare`` sends a set of evenly spread rows eight times.
    assert one_way[0] <= 400 * 7 and one_way[1] < pairs and sent <= 2 * one_way[0]


@pytest.mark.parametrize("block_rows", [7, 40])
def test_pairs_and_followers_of_groups(spark, rng, block_rows):
    limits = SimilarityLimits(broadcast_rows=4, block_rows=block_rows, max_cells=24)
    vectors = grouped_vectors(rng, 240, groups=12, spread=0.15)
    order = rng.permutation(240)
    rows = frame(spark, vectors[order])
    scores = {(i, j): cosine(vectors[order[i]], vectors[order[j]]) for i in range(240) for j in range(i)}
    near = sorted((-s, j, i) for (i, j), s in scores.items() if s > 0.97)[:300]
    pairs = similar_pairs(rows, 0.97, 300, limits).orderBy("rank").collect()
    assert [(p["id1"], p["id2"]) for p in pairs] == [(f"r{j:04d}", f"r{i:04d}") for _, j, i in near]
    follows = {r["id2"]: r["id1"] for r in nearest_lower(rows, 0.97, limits).collect()}
    best = {}
    for (i, j), s in scores.items():
        if s > 0.97:
            best[i] = min(best.get(i, (1, 0)), (-s, j))
    assert follows == {f"r{i:04d}": f"r{j:04d}" for i, (_, j) in best.items()}


def block(vectors, prefix="r"):
    vectors = np.asarray(vectors, dtype=float)
    names = np.array([f"{prefix}{i:05d}" for i in range(len(vectors))], dtype=object)
    return vb.Block(names, np.arange(len(vectors)), np.zeros(len(vectors)), vectors, np.sqrt((vectors * vectors).sum(axis=1)))


@pytest.mark.parametrize("k,earlier", [(0, False), (3, False), (3, True)])
def test_screened_pairs_hold_all_that_reach_the_bar(rng, k, earlier):
    # Lengths that differ much, and near copies that single precision cannot tell apart.
    right = rng.normal(size=(2600, 64)) * 10.0 ** rng.integers(-30, 30, size=(2600, 1))
    right[500:900] = right[500] * (1 + 1e-7 * rng.normal(size=(400, 64)))
    left, right = block(np.vstack([right[450:950], right[:700] * 2]), "l"), block(right)
    left.ord = rng.permutation(len(left)) * 2
    exact = vb.similarities(left, right)
    if earlier:
        exact[right.ord[None, :] >= left.ord[:, None]] = -np.inf
    bar = np.full(len(left), -np.inf) if k else np.where(np.arange(len(left)) % 2 == 0, 0.35, exact.max(axis=1))
    seen = np.zeros(exact.shape, dtype=bool)
    for rows, cols, sims in vb.screened(left, right, bar, k, earlier):
        assert not seen[rows, cols].any() and np.abs(sims - exact[rows, cols]).max() < 1e-11
        seen[rows, cols] = True
    if k:
        bar = np.maximum(np.partition(exact, -k, axis=1)[:, -k], -2.0)
    assert not ((exact >= bar[:, None]) & ~seen).any()


def test_few_pairs_are_multiplied_in_double_precision(rng, monkeypatch):
    rows, looked_at = block(rng.normal(size=(3000, 64))), []
    similarities, pairs = vb.similarities, getattr(vb, "pair_similarities", None)
    monkeypatch.setattr(vb, "similarities", lambda a, b: looked_at.append(len(a) * len(b)) or similarities(a, b))
    monkeypatch.setattr(vb, "pair_similarities", lambda a, b, r, c: looked_at.append(len(r)) or pairs(a, b, r, c), raising=False)
    _top_of_block(rows, rows, 3, None, False)
    best_pairs_kernel(0.85, 10)(rows, rows)
    assert 0 < sum(looked_at) < 0.05 * len(rows) ** 2


def test_followers_of_two_blocks_are_found_one_way_round(rng):
    one, two = block(rng.normal(size=(300, 8)), "a"), block(rng.normal(size=(200, 8)), "b")
    # Names of the blocks lie among each other.
    one.id, two.id = (np.array([f"{n[1:]}{n[0]}" for n in b.id], dtype=object) for b in (one, two))
    found = {}
    for names in follower_kernel(0.5, True)(one, two).to_pylist():
        found[names["id2"]] = names["id1"]
    scores = vb.similarities(one, two)
    want = {}
    for i, a in enumerate(one.id):
        for j, b in enumerate(two.id):
            if scores[i, j] > 0.5:
                low, high = min(a, b), max(a, b)
                want[high] = min(want.get(high, (1.0, "")), (-scores[i, j], low))
    assert found == {high: low for high, (_, low) in want.items()}
