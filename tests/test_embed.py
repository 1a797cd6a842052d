"""The built-in embedder, component by component."""

import math
import re

import pytest

from fadegraph.functions.embed import embed_hashed


def murmur3(data: bytes, seed: int = 42) -> int:
    """The 32-bit hash of the words, with the tail byte by byte as Spark ML has it."""
    mask, h = 0xFFFFFFFF, seed

    def spin(x, r):
        return ((x << r) | (x >> (32 - r))) & mask

    def mixed(h, k):
        k = spin(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        return (spin(h ^ k, 13) * 5 + 0xE6546B64) & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = mixed(h, int.from_bytes(data[i:i + 4], "little"))
    tail = data[whole:]
    if tail:
        k = int.from_bytes(tail, "little")
        h ^= spin(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> shift)) * factor) & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def vector(text, width):
    counts = [0.0] * width
    for word in re.split(r"\W+", (text or "").lower()):
        if word:
            counts[murmur3(word.encode()) % width] += 1.0
    length = math.sqrt(sum(c * c for c in counts))
    return [c / length if length else 0.0 for c in counts]


@pytest.mark.parametrize("width", [16, 64, 256])
def test_components(spark, width):
    texts = ["red apples", "Red, red APPLES!", "ünïcode wörds", "a", "", None, "one two three four five six seven 8 9 10"]
    rows = spark.createDataFrame(list(enumerate(texts)), "place int, text string")
    found = {r["place"]: r["embedding"] for r in embed_hashed(rows, "text", width).collect()}
    for i, text in enumerate(texts):
        assert found[i] == pytest.approx(vector(text, width), abs=1e-6)
