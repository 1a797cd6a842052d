import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fadegraph.config import SimilarityLimits
from fadegraph.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
                            spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(7)


# Limits so small that both sides are partitioned into cells and blocks.
TINY = SimilarityLimits(broadcast_rows=4, block_rows=7, max_cells=6)
LIMITS = [SimilarityLimits(), TINY]


def grouped_vectors(rng, n, width=8, groups=5, spread=0.25):
    """Vectors around a few directions, with exact copies among them."""
    centres = rng.normal(size=(groups, width))
    vectors = centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, width))
    for i in range(0, n - 1, 6):
        vectors[i + 1] = vectors[i]
    return np.round(vectors, 3)
