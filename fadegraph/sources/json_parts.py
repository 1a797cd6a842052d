"""JSON files in pieces, so that one file is the work of many tasks.

Spark's text reader cuts files at commas, wherever these stand, and deals the
byte ranges of a large file to tasks.  Neighbouring pieces become chunks, which
are written once.  A chunk alone does not say whether it starts inside a string
or how deep, so it keeps a short summary for either case; the summaries of a file
are folded in order, after which every chunk is cut at the borders of items by
itself.  Only items that lie in several chunks are put together in a shuffle.

One item is one value; so is a text without a comma.  The fold takes one small
row for each chunk of a file, in one task.  Compressed files are one range each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.session import broadcast_if_small, cut_lineage, written
from fadegraph.sources.files import file_reader

CHUNK_BYTES = 1 << 20

_QUOTE, _SLASH, _COMMA = b'"\\,'
_LIST, _OBJECT = b"[{"
_STEP = np.zeros(256, np.int8)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_MARK = _STEP != 0
_MARK[_COMMA] = True

# Of either case, out of and in a string at the start: closing brackets without an opening one, opening ones without a
# closing one and the first two of these, then for each depth that the chunk may go down to (0, 1, 2) the members or
# items of the outer value that start, and the commas at depth 2 behind the last of them.
_CASE = ("closes", "opens", "first", "starts0", "behind0", "starts1", "behind1", "starts2", "behind2")
_KEY = "source_file string, block long, number long"
_CHUNKS = f"{_KEY}, data binary, quotes long, " + ", ".join(
    f"{c}_{q} {'string' if c == 'first' else 'long'}" for q in (0, 1) for c in _CASE)
_STATES = f"{_KEY}, inside long, depth long, top string, entries long, places long, is_broken boolean"
_PARTS = f"{_KEY}, entry_ord long, position long, is_head boolean, is_listed boolean, is_whole boolean, text string"


def _arrow(schema: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, types[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _quotes(raw: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes."""
    found, slashes = np.flatnonzero(raw == _QUOTE), np.flatnonzero(raw == _SLASH)
    if not len(slashes):
        return found
    last = np.flatnonzero(np.append(np.diff(slashes) != 1, True))
    lengths = np.diff(np.append(-1, last))
    return found[~np.isin(found, slashes[last[lengths % 2 == 1]] + 1)]


def _structure(raw: np.ndarray, quotes: np.ndarray, marks: np.ndarray, inside: int):
    """Places of brackets and commas outside of strings, their steps and the depths after them."""
    places = marks[(np.searchsorted(quotes, marks) & 1) == inside]
    steps = _STEP[raw[places]].astype(np.int64)
    return places, steps, np.cumsum(steps)


def _summary(raw: np.ndarray, quotes: np.ndarray, marks: np.ndarray, inside: int) -> list:
    places, steps, after = _structure(raw, quotes, marks, inside)
    low = min(int(after.min(initial=0)), 0)
    opens = (int(after[-1]) if len(after) else 0) - low
    first = ""
    for level in range(1, min(opens, 2) + 1):
        first += chr(raw[places[np.flatnonzero((steps == 1) & (after == low + level))[-1]]])
    found = [-low, opens, first]
    for lowest in (0, 1, 2):
        one = low - lowest + 1  # what depth 1 is, counted from the start of the chunk
        starts = np.flatnonzero(((steps == 0) & (after == one)) | ((steps == 1) & (after == one) & (lowest == 0)))
        twos = np.flatnonzero((steps == 0) & (after == one + 1))
        found += [len(starts), int(np.sum(twos > starts[-1])) if len(starts) else len(twos)]
    return found


def _chunk_task(chunk_bytes: int):
    """Pieces of a scan, which come in the order of each range, to chunks that end with a comma."""
    schema = _arrow(_CHUNKS)

    def row(key: tuple[str, int], number: int, pieces: list[bytes]) -> pa.RecordBatch:
        data = b",".join(pieces) + b","
        raw = np.frombuffer(data, np.uint8)
        quotes, marks = _quotes(raw), np.flatnonzero(_MARK[raw])
        values = [*key, number, data, len(quotes), *_summary(raw, quotes, marks, 0), *_summary(raw, quotes, marks, 1)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, held, size = None, 0, [], 0
        for batch in batches:
            files, blocks = batch.column("source_file").dictionary_encode(), batch.column("block").to_numpy()
            names, codes = files.dictionary.to_pylist(), files.indices.to_numpy()
            turns = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
            pieces = batch.column("piece").to_pylist()
            for low, high in zip([0, *turns], [*turns, len(pieces)]):
                if low == high:
                    continue
                here = (names[codes[low]], int(blocks[low]))
                if here != key:
                    if held:
                        yield row(key, number, held)
                    key, number, held, size = here, 0, [], 0
                for piece in pieces[low:high]:
                    held.append(piece)
                    size += len(piece) + 1
                    if size >= chunk_bytes:
                        yield row(key, number, held)
                        number, held, size = number + 1, [], 0
        if held:
            yield row(key, number, held)

    return run


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """What is open and was counted at the start of each chunk of one file."""
    inside, depth, top, entries, places, broken, states = 0, 0, "", 0, 0, False, []
    ordered = rows.sort_values(["block", "number"])
    for values in ordered.itertuples(index=False, name=None):
        r = dict(zip(ordered.columns, values))
        states.append((r["source_file"], r["block"], r["number"], inside, depth, top, entries, places))
        closes, opens, first = (r[f"{c}_{inside}"] for c in ("closes", "opens", "first"))
        lowest = depth - closes
        broken |= lowest < 0
        lowest = max(lowest, 0)
        if lowest <= 2:
            starts, behind = r[f"starts{lowest}_{inside}"], r[f"behind{lowest}_{inside}"]
            entries, places = entries + starts, behind + (0 if starts else places)
        depth, top = lowest + opens, (top[:lowest] + first)[:2]
        inside ^= r["quotes"] & 1
    out = pd.DataFrame(states, columns=[c.split()[0] for c in _STATES.split(", ")][:-1])
    out["is_broken"] = bool(broken or inside or depth)
    return out


def _segments(data: bytes, inside: int, depth: int, top: str, entries: int, places: int):
    """Heads and items of a chunk: (entry_ord, position, is_head, is_listed, is_whole, bytes).

    A head and an item of an outer list have the position -1.
    """
    raw = np.frombuffer(data, np.uint8)
    at, steps, after = _structure(raw, _quotes(raw), np.flatnonzero(_MARK[raw]), inside)
    after = after + depth
    kept = np.where(steps == 0, (after == 1) | (after == 2), np.minimum(after, after - steps) <= 1)
    outer, inner = (ord(c) for c in (top + "  ")[:2])

    def kind_now() -> str:
        return "item" if outer == _LIST or inner == _LIST else "head"

    kind = None if depth == 0 else "head" if depth == 1 and outer != _LIST else kind_now()
    begin, whole = 0, False
    for place, step, deep in zip(at[kept].tolist(), steps[kept].tolist(), after[kept].tolist()):
        char, listed, closing = data[place], False, outer
        if step == 1 and deep == 2:
            inner = char
            if outer == _LIST or inner != _LIST:
                continue
            follows, listed = "item", True
        elif step == 0 and deep == 2:
            if outer == _LIST or inner != _LIST:
                places += 1
                continue
            follows = "item"
        elif step == -1 and deep == 1:
            if outer == _LIST or inner != _LIST:
                continue
            follows = None
        elif step == -1:
            follows = None
        else:  # a member or item of the outer value starts
            if step == 1:
                outer = char
            follows = "item" if outer == _LIST else "head"
        if kind:
            yield entries - 1, -1 if closing == _LIST or kind == "head" else places, kind == "head", listed, whole, data[begin:place]
        if deep == 1 and step != -1:
            entries, places = entries + 1, 0
        elif step == 0:
            places += 1
        kind, begin, whole = follows, place + 1, True
    if kind:
        yield entries - 1, -1 if outer == _LIST or kind == "head" else places, kind == "head", False, False, data[begin:]


def _part_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_PARTS)
    for batch in batches:
        for r in batch.to_pylist():
            found = [(r["source_file"], r["block"], r["number"], *s[:5], s[5].decode("utf-8", "replace")) for s in _segments(
                r["data"], r["inside"], r["depth"], r["top"], r["entries"], r["places"])
                if s[3] or (s[5].strip() if s[4] else s[5])]
            columns = zip(*found) if found else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def split_json(spark: SparkSession, path: str, suffix: str | None = None,
               chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, members and items of JSON files that may be larger than a task.

    Files: (source_file, is_broken), all of them; one is broken if its brackets
    or strings do not end.  Members of an outer object: (source_file, entry_ord,
    key, value), the value null where it is a list.  Items: (source_file,
    entry_ord, position, item) as JSON text, of an outer list (position null)
    or of a member that is a list.  What stands between items is not checked;
    blank items are left out, a file without values gives no rows.  Several
    outer values of a file are read as one.
    """
    pieces = file_reader(spark, suffix).option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"))
    chunks = written(pieces.mapInArrow(_chunk_task(chunk_bytes), _CHUNKS))
    states = cut_lineage(chunks.drop("data").groupBy("source_file").applyInPandas(_fold, _STATES))
    key = ["source_file", "block", "number"]
    parts = chunks.select(*key, "data").join(broadcast_if_small(states.drop("is_broken")), key).mapInArrow(_part_task, _PARTS)
    kept = ["source_file", "entry_ord", "position", "is_head", "is_listed", "text"]
    fragments = parts.filter("not is_whole").groupBy("source_file", "entry_ord", "position", "is_head").agg(
        F.max("is_listed").alias("is_listed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "number", "text"))), lambda p: p["text"]), "").alias("text"))
    whole = parts.filter("is_whole").select(kept).unionByName(fragments.select(kept))

    heads = whole.filter("is_head").filter(F.col("is_listed") | (F.trim("text") != ""))
    member = F.map_entries(F.from_json(F.concat(F.lit("{"), "text", F.when(F.col("is_listed"), F.lit("null")).otherwise(F.lit("")), F.lit("}")),
                                       "map<string,string>"))[0]
    members = heads.select("source_file", "entry_ord", "is_listed", member.alias("m")).select(
        "source_file", "entry_ord", F.col("m.key").alias("key"), F.when(~F.col("is_listed"), F.col("m.value")).alias("value"), "is_listed")
    items = whole.filter("not is_head").filter(F.trim(F.translate("text", "\t\r\n", "   ")) != "").select(
        "source_file", "entry_ord", F.when(F.col("position") >= 0, F.col("position")).alias("position"), F.col("text").alias("item"))
    # The content of a binary file is not read unless it is asked for.
    listed = file_reader(spark, suffix).format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("source_file"))
    ends = states.groupBy("source_file").agg(F.max("is_broken").alias("is_broken"))
    files = listed.join(ends, "source_file", "left").withColumn("is_broken", F.coalesce("is_broken", F.lit(False)))
    return files, members, items
