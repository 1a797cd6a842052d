"""Exact copies by composable polynomial fingerprints.

A text is normalised (each run of blanks is one space) and read as a polynomial
of its UTF-8 bytes at a fixed point, modulo two primes.  The fingerprint of two
parts joined is that of the left part, shifted by the length of the right one,
plus that of the right one.  So bytes are hashed in blocks; a huge text is cut
into chunks that many tasks hash, and its fingerprint is the sum of theirs,
each shifted by the bytes that follow it.

Rows of equal fingerprint and length are candidates.  Their normalised texts
are written in chunks, and the chunks of every candidate meet those of the first
of its group, place by place, in a sorted join; members of a large group are
salted.  Candidates that differ from it are a group of their own in the next
round, so a collision costs time and never a wrong answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.llm.shared import Texts, binaries, texts_of, tidy, write_out
from fadegraph.session import broadcast_if_small

# Primes below 2**31, so that products of residues fit 64 bits; two of them are packed into one number.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_011)
# Bytes whose terms are summed before the residue is taken.
BLOCK = 4_096
# A text of more bytes is cut into chunks of its own rows.
HUGE_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20
# Members of a group that meet its first member in one task.
SALT_ROWS = 1_024
# Narrow rows (ids, fingerprints, lengths) that may be broadcast, once counted.
MAX_BROADCAST = 300_000

_SCHEMA = "row long, doc_id long, n long, print long, text_sha256 string, place int, after long, chunk binary"


def one_space(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts with each run of blanks as one space, and where each text starts."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    edges = starts[:-1]
    keep[edges[edges < len(data)]] = True
    upto = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=upto[1:])
    return np.where(blank, np.uint8(32), data)[keep], upto[starts]


def _shift(base: int, by: np.ndarray, modulus: int) -> np.ndarray:
    """``base ** by`` modulo the prime, for each of the numbers."""
    out = np.ones(len(by), dtype=np.uint64)
    factor, left = base % modulus, by.astype(np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = out[odd] * np.uint64(factor) % np.uint64(modulus)
        factor, left = factor * factor % modulus, left >> 1
    return out


def residues(data: np.ndarray, starts: np.ndarray, modulus: int, base: int, after: np.ndarray | None = None) -> np.ndarray:
    """Residue of each text's polynomial, times the shift by the ``after`` bytes that follow it."""
    sizes = np.diff(starts)
    blocks = -(-sizes // BLOCK)
    out = np.zeros(len(sizes), dtype=np.int64)
    if not len(data):
        return out
    text = np.repeat(np.arange(len(sizes)), blocks)
    first = np.cumsum(blocks) - blocks
    begin = starts[text] + (np.arange(len(text)) - first[text]) * BLOCK
    end = np.minimum(begin + BLOCK, starts[text + 1])
    powers = _shift(base, np.arange(BLOCK), modulus)
    place = np.repeat(end, end - begin) - 1 - np.arange(len(data))
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], begin) % np.uint64(modulus)
    behind = starts[text + 1] - end
    if after is not None:
        behind = behind + after[text]
    shifted = sums * _shift(base, behind, modulus) % np.uint64(modulus)
    filled = np.flatnonzero(blocks)
    out[filled] = (np.add.reduceat(shifted, first[filled]) % np.uint64(modulus)).astype(np.int64)
    return out


def _slices(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A normalised huge text, slice by slice."""
    blank_before = False
    for at in range(0, len(data), size):
        part = data[at:at + size]
        clean, _ = one_space(part, np.array([0, len(part)]))
        if blank_before and len(clean) and clean[0] == 32:
            clean = clean[1:]
        last = part[-1]
        blank_before = last == 32 or 9 <= last <= 13
        yield clean


def _chunks(data: np.ndarray, size: int) -> Iterator[bytes]:
    """A normalised huge text in chunks of equal size but the last."""
    kept = bytearray()
    for part in _slices(data, size):
        kept += part.tobytes()
        while len(kept) >= size:
            yield bytes(kept[:size])
            del kept[:size]
    if kept:
        yield bytes(kept)


def _batch(columns: list, kinds: list[pa.DataType]) -> pa.RecordBatch:
    names = ["row", "doc_id", "n", "print", "text_sha256", "place", "after", "chunk"]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names)


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]


def _read_task(moduli: tuple[int, int], with_chunks: bool, huge: int, size: int) -> Callable:
    """(doc_id, text) to one row a text with its fingerprint, or to the chunks of a huge text without one."""

    def short(step: Texts, ids: pa.Array, firsts: int) -> pa.RecordBatch:
        data, starts = one_space(step.data, step.starts)
        high, low = (residues(data, starts, m, b) for m, b in zip(moduli, BASES))
        raw = data.tobytes()
        parts = [raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        n = len(parts)
        return _batch([firsts + np.arange(n), ids.take(pa.array(step.rows)), np.diff(starts), (high << 31) + low,
                       [hashlib.sha256(p).hexdigest() for p in parts], np.zeros(n, np.int32), np.zeros(n, np.int64),
                       parts if with_chunks else [None] * n], _KINDS)

    def long(step: Texts, ids: pa.Array, row: int) -> Iterator[pa.RecordBatch]:
        n, seen = 0, hashlib.sha256()
        for part in _slices(step.data, size):
            n += len(part)
            seen.update(part.tobytes())
        own, sha, left = ids[int(step.rows[0])], seen.hexdigest(), n
        for place, chunk in enumerate(_chunks(step.data, size)):
            left -= len(chunk)
            yield _batch([[row], [own.as_py()], [n], [None], [sha], [place], [left], [chunk]], _KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id")
            for step in texts_of(batch.column("text")):
                if len(step.data) > huge and len(step.rows) == 1:
                    yield from long(step, ids, row)
                else:
                    yield short(step, ids, row)
                row += len(step.rows)

    return tidy(run)


def _hash_chunks(moduli: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after = batch.column("after").to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                chunk = np.frombuffer(batch.column("chunk")[i].as_buffer(), dtype=np.uint8)
                parts = [residues(chunk, np.array([0, len(chunk)]), m, b, after[i:i + 1]) for m, b in zip(moduli, BASES)]
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column("row"), one.column("doc_id"), one.column("n"), one.column("text_sha256"),
                     *[pa.array(p) for p in parts]], ["row", "doc_id", "n", "text_sha256", "high", "low"])

    return tidy(run)


def _combined(table: DataFrame, moduli: tuple[int, int]) -> DataFrame | None:
    """Fingerprints of the texts that were cut, as sums of their chunks' shifted residues; None if there are none."""
    cut = table.filter("print is null")
    if cut.isEmpty():
        return None
    parts = cut.repartition("row", "place").mapInArrow(
        _hash_chunks(moduli), "row long, doc_id long, n long, text_sha256 string, high long, low long")
    packed = F.shiftleft(F.pmod(F.sum("high"), F.lit(moduli[0])), 31) + F.pmod(F.sum("low"), F.lit(moduli[1]))
    return write_out(parts.groupBy("row", "doc_id", "n", "text_sha256").agg(packed.alias("print")))


def fingerprints(docs: DataFrame, id_: str = "doc_id", text: str = "text", with_chunks: bool = False,
                 moduli: tuple[int, int] = MODULI, huge: int = HUGE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a text with its fingerprint: (row, doc_id, n, print, text_sha256), n being its normalised bytes.

    With ``with_chunks`` also (place, chunk), one row for each chunk of the
    normalised text.  ``row`` is a number of the row, the written result keeps it.
    """
    read = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = write_out(read.mapInArrow(_read_task(moduli, with_chunks, huge, chunk_bytes), _SCHEMA))
    combined = _combined(table, moduli)
    names = ["row", "doc_id", "n", "print", "text_sha256"] + (["place", "chunk"] if with_chunks else [])
    whole = table.filter("print is not null").select(*names)
    if combined is None:
        return whole
    if not with_chunks:
        return whole.unionByName(combined)
    cut = table.filter("print is null").select("row", "place", "chunk").join(combined, "row")
    return whole.unionByName(cut.select(*names))


def _meet_first(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of candidates against those of the first of their group.

    Gives (row, doc_id, text_sha256, print, n, keep_id, copies, first, same),
    one row a candidate, and the candidates' groups.
    """
    key = ["print", "n"]
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = write_out(members.filter("place = 0").groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("copies"))
                       .select(*key, F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("first"), "copies",
                               F.ceil(F.col("copies") / SALT_ROWS).cast("int").alias("salts")))
    few = broadcast_if_small(groups, MAX_BROADCAST)
    left = members.join(few, key).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    right = (members.select("row", "place", F.col("chunk").alias("first_chunk"))
             .join(few.select(*key, F.col("first").alias("row"), "salts"), "row")
             .select(*key, "place", "first_chunk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    met = left.join(right.hint("merge"), [*key, "place", "salt"])
    same = F.min(F.col("chunk") == F.col("first_chunk")).alias("same")
    return write_out(met.groupBy("row", "doc_id", "text_sha256", *key, "keep_id", "copies", "first").agg(same)), groups


def find_copies(docs: DataFrame, id_: str = "doc_id", text: str = "text", moduli: tuple[int, int] = MODULI,
                huge: int = HUGE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a document: (doc_id, keep_id, group_size, kept, print, n_bytes, text_sha256).

    Documents are copies if their texts are equal once each run of blanks is
    one space.  ``keep_id`` is the smallest id of the group, whose row is
    ``kept``; a null id counts as the largest, and of rows that share the
    smallest id one stays.  A null text counts as empty, so empty and null
    texts are copies of each other; a text of blanks alone is one space.
    ``print`` and ``n_bytes`` are the fingerprint and size of the normalised
    text, ``text_sha256`` its digest.  Other columns are dropped.  An empty
    table gives an empty result.
    """
    found = fingerprints(docs, id_, text, False, moduli, huge, chunk_bytes)
    key = ["print", "n"]
    repeated = write_out(found.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1"))
    few = broadcast_if_small(repeated.select(*key), MAX_BROADCAST)
    columns = ["doc_id", "keep_id", "group_size", "kept", "print", "n_bytes", "text_sha256"]
    out = found.join(few, key, "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        "print", F.col("n").alias("n_bytes"), "text_sha256")
    # Texts of the candidates are read a second time, so that those of other rows are never written.
    ids = broadcast_if_small(write_out(found.join(few, key, "left_semi").select(F.col("doc_id").alias("__id")).distinct()), MAX_BROADCAST)
    again = docs.join(ids, F.col(id_).cast("long").eqNullSafe(F.col("__id")), "left_semi")
    members = fingerprints(again, id_, text, True, moduli, huge, chunk_bytes).join(few, key, "left_semi")
    while True:
        met, groups = _meet_first(members)
        other = met.filter("not same")
        equal = met.filter("same")
        collided = not other.isEmpty()
        if collided:
            sizes = write_out(equal.groupBy(*key).agg(F.count("*").alias("equals")))
            equal = equal.drop("copies").join(broadcast_if_small(sizes, MAX_BROADCAST), key).withColumnRenamed("equals", "copies")
        out = out.unionByName(equal.select(
            "doc_id", "keep_id", F.col("copies").alias("group_size"), (F.col("row") == F.col("first")).alias("kept"),
            "print", F.col("n").alias("n_bytes"), "text_sha256").select(*columns))
        if not collided:
            return out
        members = write_out(members.join(broadcast_if_small(other.select("row"), MAX_BROADCAST), "row", "left_semi"))
