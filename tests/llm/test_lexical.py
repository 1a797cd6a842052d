"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fadegraph.llm import lexical

DOCS = "doc_id long, text string, n int, terms string, query long"
ITEMS = "item_id long, text string, terms string, score int"
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = {ord(a): b for a, b in zip(lexical.UPPER, lexical.LOWER)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def prose(rng, n, pool=300):
    return " ".join(rng.choice(["", "É", "ß"]) + f"W{int(pool * rng.random() ** 3)}" + rng.choice(["", ",", "-x"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    out = [(i, prose(rng, rng.randrange(1, 120))) for i in range(400)]
    out += [(400 + i, out[3][1]) for i in range(130)]  # a third are copies
    out += [(600, None), (601, ""), (602, " .,\n"), (603, "日本 語w1"), (604, prose(rng, 20_000, 5_000)), (605, "w1" * 40_000), (None, out[3][1]),
            (None, out[5][1]), (7, out[7][1]), (7, out[7][1])]
    return out


@pytest.fixture(scope="module")
def items(docs):
    rng = random.Random(10)
    out = [(i, " ".join(docs[i * 7][1].split()[:30])) for i in range(20)]
    out += [(100 + i, prose(rng, 25)) for i in range(10)]
    out += [(200, None), (201, ""), (202, "?!"), (203, "unheard0f"), (204, "語W1 日本"), (205, "w1 " * 500), (206, "w1" * 40_000), (None, "w1 w2"), (0, "w250")]
    return out


def model(docs, items, k=10):
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    holders = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c, s in zip(docs, counts, sizes):
            score = 0
            for t in set(terms(text)) & set(c):
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * holders[t] + 1)))
                score += weight * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * s * n // length)))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, 1, "clash", 5) for r in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*r, "clash", 1) for r in items], ITEMS).repartition(2)
    return sorted(str(tuple(r)) for r in lexical.rank_documents(d, q, **how).collect())


def test_ranking(spark, docs, items):
    assert found(spark, docs, items) == model(docs, items)


def test_small_chunks_blocks_and_groups(spark, docs, items, monkeypatch):
    for name, value in (("CHUNK_ROWS", 50), ("BLOCK_ROWS", 4), ("SLICE_BYTES", 1_000)):
        monkeypatch.setattr(lexical, name, value)
    assert found(spark, docs, items, group_pairs=150) == model(docs, items)


def test_nothing_to_rank(spark, docs, items):
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [(1, None)], items) == []
    assert found(spark, docs, [(1, "unheard0f")]) == []


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(4)
    impacts = np.zeros((3_000, 40), dtype=np.int32)
    kind = rng.integers(6, size=3_000)
    for t in range(40):  # documents of a kind share terms, the last terms are everywhere
        holds = (kind == t % 6) & (rng.random(3_000) < 0.7) if t < 30 else rng.random(3_000) < 0.8
        impacts[holds, t] = rng.integers(100, 1_000, size=int(holds.sum()))
    weights = np.sort(rng.integers(10, 9_000, size=40))[::-1].astype(np.int64)
    queries = [(q, np.sort(rng.choice(40, size=9, replace=False))) for q in range(12)]
    asked = lexical.Asked(weights, np.arange(40), queries)
    chunk = lexical.Chunk(impacts, asked)
    skipped = scored = 0
    for _, ranks in queries:
        want = impacts[:, ranks].astype(np.int64) @ weights[ranks]
        docs, scores, a, b = chunk.search(ranks, 10, 1)
        assert sorted(scores)[-10:] == sorted(want)[-10:] and (want[docs] == scores).all()
        assert set(np.flatnonzero(want >= np.sort(want)[-10])) <= set(docs.tolist())
        scored, skipped = scored + a, skipped + b
    assert skipped > scored
    for docs, ends, summary in chunk.blocks.values():
        assert ends[-1] == len(docs) and len(summary) == len(ends) - 1
