"""Removal of repeated passages, with a count-min sketch in front of an exact grouping.

A window is ``window`` consecutive words of one text.  Windows are sketched
under their *anchor*: the smallest hash among the runs of ``ANCHOR_WORDS``
words within the window.  Equal windows have equal anchors, so the count of an
anchor is never below the count of any of its windows, and neighbouring
windows mostly share one, which makes the sketch about twenty times smaller.

1. Texts that are copies of one another are told apart by a digest; only the
   copy with the lowest id goes on, since every window of the others starts in it.
2. Each task sketches its anchors, once for each text and anchor, in saturating
   cells; the partition sketches are merged cell by cell.
3. A second pass hands on the windows whose anchor is estimated to occur in
   more than one text; they are grouped exactly, by 128 bits of hash, with
   partial aggregation, so a window that a third of all texts share is one row
   of each task.  Windows that many rows hold are then looked up from a broadcast
   table, counted before, and only the rows of the others are shuffled.
4. The covered words of each text are removed.

The merged sketch follows the input up to a bound (``sketch.MAX_WIDTH``, 64 MB
to broadcast).  Beyond that it fills up, and more windows take part in the
exact grouping; results are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadegraph.llm.shared import (
    Texts, id_or_last, id_or_null, runs_hashes, signed, sliding_min, span_hashes, texts_of, write_out)
from fadegraph.llm.sketch import repeated_keys
from fadegraph.session import broadcast_if_small

WINDOW_WORDS = 50
ANCHOR_WORDS = 8
# Pairs of a digest and an id that may be broadcast, once counted.
MAX_BROADCAST = 500_000
# A window that more rows hold is heavy.
HEAVY_ROWS = 1_000
_SECOND_BASE = 0x2545F4914F6CDD1D


def _windows(texts: Texts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and for each window that lies in one text: first word, text number and anchor."""
    starts, ends, text = texts.words()
    words = span_hashes(texts.data, starts, ends)
    short = min(ANCHOR_WORDS, window)
    if len(words) < window:
        none = np.zeros(0, dtype=np.int64)
        return words, none, none, none.astype(np.uint64)
    anchors = sliding_min(runs_hashes(words, short), window - short + 1)
    first = np.flatnonzero(text[:len(text) - window + 1] == text[window - 1:])
    return words, first, text[first], anchors[first]


def _text_anchors(window: int):
    """Anchors of the texts of a batch, each once for each text."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for texts in texts_of(batch.column("text")):
            _, _, text, anchor = _windows(texts, window)
            for _ in range(2):  # neighbouring windows mostly share their anchor: sort only what is left
                new = np.ones(len(anchor), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                text, anchor = text[new], anchor[new]
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
            yield anchor

    return keys


def _repeated_windows(window: int, sketch):
    """Windows whose anchor the sketch holds to be in more than one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = sketch.value
        for batch in batches:
            ids = batch.column("did").to_numpy(zero_copy_only=False)
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            marks2 = batch.column("mark2").to_numpy(zero_copy_only=False)
            for texts in texts_of(batch.column("text")):
                words, first, text, anchor = _windows(texts, window)
                often = repeated(anchor)
                first, text = first[often], text[often]
                if len(first):
                    rows = texts.rows[text]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(runs_hashes(words, window)[first])),
                         pa.array(signed(runs_hashes(words, window, _SECOND_BASE)[first])),
                         pa.array(ids[rows]), pa.array(marks[rows]), pa.array(marks2[rows]),
                         pa.array((first - _first_words(texts)[text]).astype(np.int32))],
                        ["w1", "w2", "did", "mark", "mark2", "place"])

    return run


def _first_words(texts: Texts) -> np.ndarray:
    """Number of the first word of each text within the step."""
    starts, _, _ = texts.words()
    return np.searchsorted(starts, texts.starts[:-1])


def covered(places: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a window that starts at one of the places."""
    steps = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _strip(window: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, places = batch.column("did"), batch.column("copy"), batch.column("places")
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for texts in texts_of(batch.column("text")):
                starts, ends, text = texts.words()
                edges = np.searchsorted(text, np.arange(len(texts.rows) + 1))
                for i, row in enumerate(texts.rows):
                    low, high = edges[i], edges[i + 1]
                    n = int(high - low)
                    gone = np.zeros(n, dtype=bool)
                    if copies[row].as_py():
                        gone[:] = n >= window
                    elif places[row].is_valid:
                        gone = covered(np.asarray(places[row].values), n, window)
                    keep = np.flatnonzero(~gone) + low
                    data = texts.data.tobytes() if len(texts.rows) == 1 else texts.data[texts.starts[i]:texts.starts[i + 1]].tobytes()
                    if len(keep) == n:
                        kept = b" ".join(data.split())  # bytes split at exactly the six blanks
                    else:
                        base = int(texts.starts[i])
                        kept = b" ".join(data[a:b] for a, b in zip((starts[keep] - base).tolist(), (ends[keep] - base).tolist()))
                    n_words.append(n)
                    n_removed.append(n - len(keep))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_texts.append(kept.decode())
            columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_texts, pa.string())] * with_text, names)

    return run


def _same_text(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("mark"), F.xxhash64(F.lit(7), text).alias("mark2")]


def remove_repeats(docs: DataFrame, id_: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS,
                   with_text: bool = True) -> DataFrame:
    """Each text without the words of passages that start in a text of a smaller id.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` and, if ``with_text``,
    ``kept_text`` (kept words joined by one space), one row for each row of
    ``docs``.  Words are runs without the six ASCII blanks.  A null or blank
    text has no words.  Rows that share an id never remove words of each other;
    a null id counts as the largest and stays null.  Other columns are dropped.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(id_or_last(id_).alias("did"), F.col(text).cast("string").alias("text")).select(
        "did", "text", *_same_text(F.col("text")))
    sizes = rows.select("did", "mark", "mark2", F.octet_length("text").alias("size"))
    firsts = sizes.groupBy("mark", "mark2").agg(
        F.min("did").alias("first"), F.max("did").alias("last"), F.sum("size").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    n_anchors = total / 5 * 2 / max(window - ANCHOR_WORDS + 2, 2)
    copies = write_out(firsts.filter("first < last").select("mark", "mark2", "first"))
    later = write_out(sizes.join(broadcast_if_small(copies, MAX_BROADCAST), ["mark", "mark2"]).filter("did > first").select(
        "did", "mark", "mark2").distinct())
    lone = rows.join(broadcast_if_small(later, MAX_BROADCAST), ["did", "mark", "mark2"], "left_anti")
    sketch = spark.sparkContext.broadcast(repeated_keys(lone.select("text"), _text_anchors(window), n_anchors))
    windows = write_out(lone.mapInArrow(
        _repeated_windows(window, sketch), "w1 long, w2 long, did long, mark long, mark2 long, place int"))
    sketch.destroy()
    shared = windows.groupBy("w1", "w2").agg(
        F.min("did").alias("low"), F.max("did").alias("high"), F.count("*").alias("held")).filter("low < high")
    shared = write_out(shared.select("w1", "w2", "low", "held"))
    # Windows that very many rows hold are few; sent to all tasks, none of their rows has to be shuffled.
    heavy = broadcast_if_small(shared.filter(F.col("held") > HEAVY_ROWS).select("w1", "w2", "low"), MAX_BROADCAST)
    light = shared.filter(F.col("held") <= HEAVY_ROWS).select("w1", "w2", "low")
    usual = windows.join(heavy.select("w1", "w2"), ["w1", "w2"], "left_anti")
    hits = windows.join(heavy, ["w1", "w2"]).unionByName(usual.join(light, ["w1", "w2"])).filter("did > low").select(
        "did", "mark", "mark2", "place")
    marks = hits.unionByName(later.select("did", "mark", "mark2", F.lit(-1).alias("place"))).groupBy("did", "mark", "mark2").agg(
        F.collect_set("place").alias("places"))
    joined = rows.join(marks, ["did", "mark", "mark2"], "left").select(
        "did", "text", F.coalesce(F.array_contains("places", -1), F.lit(False)).alias("copy"), "places")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    stripped = joined.mapInArrow(_strip(window, with_text), out)
    return stripped.withColumn("doc_id", id_or_null("doc_id"))
