"""Exact copies against a dictionary of whole texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from fadegraph.llm import fingerprints

SCHEMA = "doc_id long, text string, print string, n int, row long, chunk string"
BLANKS = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    long = " ".join(f"wörd{rng.randrange(50)}" for _ in range(900))
    other = long[:-1] + "é"
    out = [(0, None), (1, ""), (2, " \t\n"), (3, " "), (4, "a b"), (5, "a b"), (6, "a\n\n b"), (7, " a b"), (8, "ab")]
    out += [(i, rng.choice(["same text", "same \v text", "Same text"])) for i in range(20, 60)]
    out += [(60, long), (61, long.replace(" ", "\r\n")), (62, other), (63, long + " "), (64, other.replace(" ", "  "))]
    out += [(65, "x" * 9_000), (66, "x" * 9_001), (67, "x" * 9_000), (68, "\u0000"), (69, "\u0000\u0000")]
    out += [(None, "a b"), (None, "alone"), (None, "alone "), (None, "alone "), (4, "a b"), (4, "other"), (4, "other")]
    return [(*r, "clash", 1, 2, "clash") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def last(i):
    return (i is None, i or 0)


def model(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(BLANKS.sub(" ", text or ""), []).append(i)
    out = []
    for body, ids in groups.items():
        keep, *rest = sorted(ids, key=last)
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(keep, keep, len(ids), True, sha)] + [(i, keep, len(ids), False, sha) for i in rest]
    return sorted(map(str, out))


def found(table, **how):
    result = fingerprints.find_copies(table, **how).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted(str(tuple(r)) for r in result.collect())


@pytest.mark.parametrize("how", [
    {}, {"huge": 64, "chunk_bytes": 1_000}, {"moduli": (2, 2)}, {"moduli": (2, 3), "huge": 64, "chunk_bytes": 700}], ids=["usual", "cut", "collisions", "cut collisions"])
def test_copies(docs, rows, how, monkeypatch):
    monkeypatch.setattr(fingerprints, "SALT_ROWS", 8)
    assert found(docs, **how) == model(rows)


def test_no_documents(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_fingerprints_compose():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, size=30_000).astype(np.uint8)
    for modulus, base in zip(fingerprints.MODULI, fingerprints.BASES):
        whole = 0
        for byte in data.tolist():
            whole = (whole * base + byte + 1) % modulus
        cuts = np.array([0, 1, 4_096, 4_097, 20_000, 30_000])
        parts = sum(int(fingerprints.residues(data[a:b], np.array([0, b - a]), modulus, base, np.array([len(data) - b]))[0])
                    for a, b in zip(cuts, cuts[1:]))
        assert parts % modulus == whole == fingerprints.residues(data, np.array([0, len(data)]), modulus, base)[0]
        # Texts beside each other keep their own fingerprints.
        each = fingerprints.residues(data, cuts, modulus, base)
        assert each[2] == fingerprints.residues(data[4_096:4_097], np.array([0, 1]), modulus, base)[0]


def test_blanks_across_slices():
    for text in (b"a  b", b"ab   c", b"   ", b"abc   def", b"\t\n\r a\v\f", b""):
        data = np.frombuffer(text, dtype=np.uint8)
        want = re.sub(rb"[\x20\x09-\x0D]+", b" ", text)
        chunks = list(fingerprints._chunks(data, 3))
        assert b"".join(chunks) == want and all(len(c) == 3 for c in chunks[:-1])
        clean, starts = fingerprints.one_space(data, np.array([0, len(data)]))
        assert clean.tobytes() == want and starts.tolist() == [0, len(want)]
