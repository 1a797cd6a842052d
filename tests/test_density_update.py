"""Clusters kept up to date against clustering everything again."""

import numpy as np

from fadegraph.config import SimilarityLimits
from fadegraph.operators.density import dbscan
from fadegraph.operators.density_update import update_clusters
from tests.conftest import grouped_vectors


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, vec array<double>")


def labels(df):
    return {r["id"]: (r["is_core"], r["cluster"]) for r in df.collect()}


def test_batches_give_what_a_full_run_gives(spark):
    limits, spread, batches = SimilarityLimits(), 0.6, 3
    rng = np.random.default_rng(int(spread * 100))
    vectors = grouped_vectors(rng, 110, width=4, groups=6, spread=spread)
    vectors[40:52] = vectors[40]
    pool = [(f"p{i:03d}", v) for i, v in enumerate(vectors)]
    held, state = {}, None
    order = list(rng.permutation(110))
    for batch in range(batches):
        taken = order[batch * 30:(batch + 1) * 30]
        come = [pool[i] for i in taken]
        gone = [] if not held else [str(x) for x in rng.choice(sorted(held), size=min(9, len(held)), replace=False)]
        # Two rows move: they are removed and come again elsewhere.
        come += [(i, vectors[int(rng.integers(110))]) for i in gone[:2]]
        for i in gone:
            del held[i]
        held.update(come)
        removed = spark.createDataFrame([(i,) for i in gone], "id string")
        state = update_clusters(state, table(spark, come), removed, limits=limits)
        assert labels(state) == labels(dbscan(table(spark, held.items()), "id", "vec", limits=limits))


def test_nothing_changes_and_all_goes(spark):
    rows = table(spark, [(f"p{i}", [1.0, i / 50]) for i in range(8)] + [("zero", [0.0, 0.0]), ("far", [-1.0, 0.0])])
    state = update_clusters(None, rows)
    assert labels(state) == {i: x for i, x in labels(dbscan(rows, "id", "vec")).items() if i != "zero"}
    same = update_clusters(state, rows.limit(0))
    assert labels(same) == labels(state)
    assert labels(update_clusters(state, rows.limit(0), rows.select("id"))) == {}
