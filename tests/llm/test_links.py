"""Counts of links of the Jaccard join against all pairs."""

import random
from collections import Counter

from fadegraph.llm import jaccard
from tests.llm.test_texts import SCHEMA, docs, none, rows, sentence, words  # noqa: F401


def shingles(text):
    w = [x.lower() if x.isascii() else x for x in words(text)]
    return {tuple(w[j:j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}


def linked_rows(texts):
    sets = [shingles(t) for t in texts]
    return [sum(i != j and bool(a & b) and 100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def test_links_of_each_row(docs, rows, none):  # noqa: F811
    want = Counter((r[0], n) for r, n in zip(rows, linked_rows([r[1] for r in rows])))
    found = jaccard.similar_documents(docs, shingle_words=4, percent=85, count_links=True)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "mark", "n_links"]
    assert Counter((r.doc_id, r.n_links) for r in found.collect()) == want
    assert jaccard.similar_documents(none, count_links=True).collect() == []


def test_links_over_blocks(spark, monkeypatch):
    """Every pair of a group of near copies is decided, not only those that join it."""
    monkeypatch.setattr(jaccard, "LINK_ROWS", 7)
    rng = random.Random(3)
    base, texts = sentence(rng, 150).split(), []
    for _ in range(50):
        edited = list(base)
        for _ in range(rng.randrange(1, 5)):
            edited[rng.randrange(150)] = f"x{rng.randrange(9)}"
        texts += [" ".join(edited)] * rng.randrange(1, 3)
    table = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = Counter((i // 2, n) for i, n in enumerate(linked_rows(texts)))
    got = jaccard.similar_documents(table, shingle_words=4, percent=85, count_links=True).collect()
    assert len({n for _, n in want}) > 5 and Counter((r.doc_id, r.n_links) for r in got) == want
