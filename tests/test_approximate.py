"""Approximate ways against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fadegraph.config import SimilarityLimits
from fadegraph.operators import approximate as ap
from fadegraph.operators import vector_blocks as vb
from fadegraph.operators.similarity import nearest, similar_pairs
from tests.conftest import TINY, grouped_vectors


def points(spark, vectors, prefix="v"):
    rows = [(f"{prefix}{i:04d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return vb.side(spark.createDataFrame(rows, "id string, vec array<double>"), "id", "vec")


@pytest.fixture(scope="module")
def base(spark):
    return points(spark, grouped_vectors(np.random.default_rng(3), 900, 16, 30, 0.4))


def found(df):
    return sorted((r["l_id"], r["rank"], r["r_id"], r["similarity"]) for r in df.collect())


def test_cells_find_what_was_asked_for(spark, base, tmp_path):
    asked = points(spark, grouped_vectors(np.random.default_rng(3), 900, 16, 30, 0.4)[::7] + 0.01, "q")
    ap.store_cells(base, str(tmp_path), 24)
    stored = ap.load_cells(spark, str(tmp_path))
    exact = nearest(asked, base, 4)
    got, measured = ap.nearest_in_cells(stored, asked, 4, 0.95)
    assert measured >= 0.95 and ap.share_found(exact, got, ["l_id", "r_id"]) >= 0.9
    probes, _ = ap.probes_for(stored, asked, 4, 0.95)
    assert probes < 24
    # All cells together are the exact way; scores of what is found are exact in any case.
    assert found(ap.search_cells(stored, asked, 4, 24)) == found(exact)
    assert found(ap.search_cells(stored, asked, 4, 24, TINY)) == found(exact)
    everything = {(q, v): s for q, _, v, s in found(nearest(asked, base, 900))}
    assert all(everything[q, v] == s for q, _, v, s in found(got))


def test_only_visited_cells_are_read(spark, base, tmp_path):
    stored = ap.store_cells(base, str(tmp_path), 24)
    one = base.limit(1)
    got = ap.search_cells(stored, one, 3, 2)
    visited = sorted({r["cell"] for r in ap._nearest_cells(one, stored.cells, 2).collect()})
    scans = [x for x in stored.rows(visited)._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x]
    assert len(visited) == 2 and "PartitionFilters: [cell#" in scans[0] and f"IN ({visited[0]},{visited[1]})" in scans[0]
    assert "PartitionFilters: [cell#" in got._jdf.queryExecution().executedPlan().toString()
    assert {r["cell"] for r in stored.rows(visited).collect()} == set(visited) < {r["cell"] for r in stored.rows().collect()}
    assert len(got.collect()) == 3


@pytest.mark.parametrize("limits", [SimilarityLimits(), SimilarityLimits(block_rows=32)])
def test_hashed_pairs(spark, base, limits):
    exact = similar_pairs(base, 0.9, 400)
    hashed = ap.similar_pairs_hashed(base, 0.9, 400, 0.97, limits)
    scores = {(r["id1"], r["id2"]): r["similarity"] for r in similar_pairs(base, 0.9, 1_000_000).collect()}
    rows = hashed.collect()
    assert ap.share_found(exact, hashed, ["id1", "id2"]) >= 0.9
    assert all(scores[r["id1"], r["id2"]] == r["similarity"] for r in rows)
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_more_rows_need_more_bits_and_tables():
    small, large = (ap.hash_plan(n, 0.85, 0.95, SimilarityLimits()) for n in (1_000, 100_000_000))
    assert small[0] < large[0] and small[1] < large[1]
    assert ap.hash_plan(10_000, 1.0, 0.95, SimilarityLimits())[1] == 1


def test_nothing_to_find(spark, base, tmp_path):
    alone = base.filter("id = 'v0003'")
    stored = ap.store_cells(alone, str(tmp_path))
    got, measured = ap.nearest_in_cells(stored, alone, 3)
    assert [r["r_id"] for r in got.collect()] == ["v0003"] and measured == 1.0
    assert ap.similar_pairs_hashed(alone, 0.5).collect() == []
    assert ap.similar_pairs_hashed(base.filter(F.col("id") < "v"), 0.5).collect() == []


def test_visited_cells_are_kept_as_bits(spark, base, tmp_path):
    cells = ap.store_cells(base, str(tmp_path), 24).cells
    n_cells = len(cells.counts)
    probed = ap._probed(base, cells, 5).cache()
    packed = vb.pack_visits(probed, n_cells)
    bits = {r["id"]: set(np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["visited"]), dtype=np.uint8)))) for r in packed.collect()}
    assert "cells" not in packed.columns
    assert bits == {r["id"]: set(r["cells"]) for r in probed.collect()}
    assert vb.cells_visited(packed, n_cells) == sorted(set().union(*bits.values()))
    # However many cells are visited, a visitor keeps one bit for each.
    assert {len(r["visited"]) for r in vb.pack_visits(ap._probed(base, cells, n_cells), n_cells).collect()} == {-(-n_cells // 8)}
