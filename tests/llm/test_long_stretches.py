"""Text without spaces: segments of long stretches against reading them from the start."""

import random
import time

import numpy as np
import pytest

from fadegraph.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.read_model()


def letters(rng, n, alphabet):
    return "".join(rng.choice(alphabet) for _ in range(n))


def stretches():
    rng = random.Random(8)
    words = ["the", "ing", "tion", "quick", "él", "straße", "a", "q", "zz", "0x"]
    prose = "".join(rng.choice(words) for _ in range(2_500))
    han = "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(2_500))
    texts = [prose, han, letters(rng, 6_000, "ABCdef0123456789+/"), "a" * 5_000, "=" * 900 + prose[:700] + "=" * 3_000, "😀é\u0001" * 700,
             prose[:257], han[:100], "▁" + prose[:600]]
    return [("▁" + t).encode() for t in texts]


def read_from_the_start(model, stretch):
    known = ([0.0], [-1], [0])
    model._read_on(stretch, *known, len(stretch))
    return model._back(stretch, *known[1:])


def test_segments_give_what_whole_stretches_give(model):
    given = stretches()
    want, counts = model.encode_stretches(given)
    want = np.split(want, np.cumsum(counts)[:-1])
    for found in (model.encode_long(given), [model.encode_long([s])[0] for s in given], [read_from_the_start(model, s) for s in given]):
        assert all(np.array_equal(a, b) for a, b in zip(found, want))


def test_scores_that_are_not_whole(model):
    rng = np.random.default_rng(3)
    spread = pieces.Pieces.__new__(pieces.Pieces)
    spread.__setstate__(model.__getstate__())
    spread.scores, spread.whole = model.scores + rng.random(len(model.scores)), False
    given = stretches()
    want, counts = spread.encode_stretches(given)
    assert all(np.array_equal(a, b) for a, b in zip(spread.encode_long(given), np.split(want, np.cumsum(counts)[:-1])))


def test_long_texts_without_spaces_end_in_time(model):
    rng = random.Random(9)
    given = [("▁" + letters(rng, 1_000, "etaoinshrdlu語日本")).encode() for _ in range(60)] + [("▁" + letters(rng, 60_000, "etaoin")).encode()]
    model.encode_long(given[:1])
    start = time.process_time()
    found = model.encode_long(given)
    assert time.process_time() - start < 10  # some 35 s before they were cut
    assert all(b"".join(model.surfaces[i] for i in ids.tolist()) == s.replace("▁".encode(), b" ") for ids, s in zip(found, given))
