"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton runs over the bytes of the pieces.  After each byte its state
names the longest piece that ends there and, by output links, all shorter ones;
each of them relaxes the best score at that position from the position where it
starts.  Scores are the model's, the best segmentation is the one of the
largest sum, and of equal ones the one whose last differing piece is longer.  A
character that no piece covers is written as its bytes.

No piece goes on with a space mark after another character, so a text is
segmented by *stretches*: a run of space marks and what follows it up to the
next one.  A step of texts encodes each distinct stretch once, all of them
together, one byte position after the other.

A long stretch (text without spaces) is cut into segments that overlap, and all
segments of a step go together.  Where the best scores of a segment differ from
those of the one before by the same amount over as many positions as the
longest piece has bytes, all that follows is the same as if the stretch had been
read from its start, and the segment is joined there.  Segments that do not come
to that in their overlap (long runs of one character) are read on one byte after
the other from where the scores are known, and so are all if scores are not
whole numbers, whose sums differ with where they start.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from fadegraph.llm.shared import id_or_last, id_or_null, span_hashes, texts_of, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_MARK = SPACE.encode()
# The score of a character that is written as bytes: below any piece's.
_UNKNOWN_GAP = 10.0
# Stretches of more bytes than this are cut into segments of so many bytes that overlap.
LONG_STRETCH = 256
SEGMENT, OVERLAP = 512, 128
# Cells (positions by segments) that are worked on together, and segments below which a plain loop is faster.
SEGMENT_CELLS = 1 << 20
FEW_SEGMENTS = 24
# Stretches that are encoded together.
TOGETHER = 4_096
# Encoded stretches that a worker keeps, about 10 MB.
STORED_STRETCHES = 200_000


class Pieces:
    """A vocabulary and the automaton over it, in arrays that are cheap to send."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], normal: Sequence[bool], byte_ids: Sequence[int]):
        """``normal`` tells which pieces match text; ``byte_ids`` has the id of each byte's piece."""
        self.byte_ids = np.asarray(byte_ids, dtype=np.int32)
        self.surfaces = [p.replace(SPACE, " ").encode() if n else b"" for p, n in zip(pieces, normal)]
        for value, i in enumerate(byte_ids):
            self.surfaces[i] = bytes([value])
        known = {p.encode(): i for i, (p, n) in enumerate(zip(pieces, normal)) if n and p}
        for piece in pieces:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"a piece has a space mark after another character: {piece!r}")
        self.scores = np.asarray(scores, dtype=np.float64)
        self.unknown = min((self.scores[i] for i in known.values()), default=0.0) - _UNKNOWN_GAP
        children: list[dict[int, int]] = [{}]
        depth, piece_at = [0], [-1]
        for piece, i in sorted(known.items()):
            state = 0
            for byte in piece:
                after = children[state].get(byte)
                if after is None:
                    after = len(children)
                    children[state][byte] = after
                    children.append({})
                    depth.append(depth[state] + 1)
                    piece_at.append(-1)
                state = after
            piece_at[state] = i
        n = len(children)
        self.depth = np.array(depth, dtype=np.int32)
        self.piece_at = np.array(piece_at, dtype=np.int32)
        fail, output = np.zeros(n, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        queue = list(children[0].values())
        for state in queue:  # breadth first: the queue grows while it is read
            up = int(fail[state])
            output[state] = up if piece_at[up] >= 0 else output[up]
            for byte, after in children[state].items():
                at = up
                while at and byte not in children[at]:
                    at = int(fail[at])
                fail[after] = children[at].get(byte, 0) if children[at].get(byte, 0) != after else 0
                queue.append(after)
        self.fail, self.output = fail, output
        # First state on the way of output links, itself included, that ends a piece.
        own = np.arange(n, dtype=np.int32)
        self.first_output = np.where(self.piece_at >= 0, own, output)
        self.longest = max(int(self.depth.max()), 4)
        self.whole = bool((self.scores == np.rint(self.scores)).all())
        self.trie_keys = np.array([a * 256 + b for a, c in enumerate(children) for b in c], dtype=np.int64)
        self.trie_ends = np.array([e for c in children for e in c.values()], dtype=np.int32)
        self._forget()

    def _forget(self) -> None:
        """An empty store of encoded stretches: sorted hashes, and the place and number of their ids."""
        self._hashes = np.zeros(0, dtype=np.uint64)
        self._places, self._counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self._ids = np.zeros(0, dtype=np.int32)
        self._ends: dict[int, list[tuple[int, float, int]]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_hashes", "_places", "_counts", "_ids", "_ends", "moves")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def encode_known(self, hashes: np.ndarray, stretch_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the ids of each stretch, and the array they are in.

        ``hashes`` are distinct and sorted; ``stretch_of`` gives the stretches
        of some of them.  What was met before is not encoded again; the store
        starts anew when it is full.
        """
        at = np.minimum(np.searchsorted(self._hashes, hashes), max(len(self._hashes) - 1, 0))
        new = self._hashes[at] != hashes if len(self._hashes) else np.ones(len(hashes), dtype=bool)
        if new.any():
            if len(self._hashes) + int(new.sum()) > STORED_STRETCHES:
                self._forget()
                new[:] = True
            ids, counts = _encode_distinct(self, stretch_of(np.flatnonzero(new)))
            places = len(self._ids) + np.cumsum(counts) - counts
            into = np.searchsorted(self._hashes, hashes[new])
            self._hashes = np.insert(self._hashes, into, hashes[new])
            self._places = np.insert(self._places, into, places)
            self._counts = np.insert(self._counts, into, counts)
            self._ids = np.concatenate([self._ids, ids])
            at = np.searchsorted(self._hashes, hashes)
        return self._places[at], self._counts[at], self._ids

    @cached_property
    def moves(self) -> np.ndarray:
        """The state after each state and byte, worked out where it is used; 256 numbers a state."""
        n = len(self.depth)
        moves = np.zeros((n, 256), dtype=np.uint16 if n <= 1 << 16 else np.int32)
        at, byte = np.divmod(self.trie_keys, 256)
        order = np.argsort(self.depth[at], kind="stable")
        at, byte, ends = at[order], byte[order], self.trie_ends[order]
        cuts = np.searchsorted(self.depth[at], np.arange(int(self.depth.max()) + 2))
        moves[0, byte[:cuts[1]]] = ends[:cuts[1]]
        by_depth = np.argsort(self.depth, kind="stable")
        levels = np.searchsorted(self.depth[by_depth], np.arange(int(self.depth.max()) + 2))
        for d in range(1, len(levels) - 1):
            own = by_depth[levels[d]:levels[d + 1]]
            moves[own] = moves[self.fail[own]]  # of a lesser depth, so it is complete
            edges = slice(cuts[d], cuts[d + 1])
            moves[at[edges], byte[edges]] = ends[edges]
        return moves

    def _forward(self, stretches: list[bytes]) -> tuple[np.ndarray, ...]:
        """Best score of every position of each stretch, and the piece and width that give it.

        Columns are stretches in the returned order, the longest first.
        """
        m = len(stretches)
        sizes = np.array([len(s) for s in stretches], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        longest = int(sizes[0]) if m else 0
        moves = self.moves
        data = np.zeros((longest, m), dtype=np.uint8)  # byte position by stretch, long ones first
        flat = np.frombuffer(b"".join(stretches[i] for i in order.tolist()), dtype=np.uint8)
        ends = np.cumsum(sizes)
        column = np.repeat(np.arange(m), sizes)
        data[np.arange(len(flat)) - np.repeat(ends - sizes, sizes), column] = flat
        best = np.full((longest + 1, m), -np.inf)
        best[0] = 0.0
        piece = np.full((longest + 1, m), -1, dtype=np.int32)
        width = np.zeros((longest + 1, m), dtype=np.int32)
        start = np.zeros(m, dtype=np.int64)  # of the character that position lies in
        states = np.zeros(m, dtype=np.int32)
        alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # stretches that reach a position
        for j in range(longest):
            k = int(alive[j])
            byte = data[j, :k]
            start[:k] = np.where((byte & 0xC0) != 0x80, j, start[:k])
            states = moves[states[:k], byte]
            character = j + 1 - start[:k]
            bare = np.ones(k, dtype=bool)  # no piece is the character that ends here
            rows = np.arange(k)
            at = self.first_output[states]
            live = at >= 0
            rows, at = rows[live], at[live]
            while len(rows):
                size = self.depth[at]
                score = best[j + 1 - size, rows] + self.scores[self.piece_at[at]]
                better = score > best[j + 1, rows]
                hit = rows[better]
                best[j + 1, hit] = score[better]
                piece[j + 1, hit] = self.piece_at[at[better]]
                width[j + 1, hit] = size[better]
                bare[rows[size == character[rows]]] = False
                at = self.output[at]
                live = at >= 0
                rows, at = rows[live], at[live]
            # A whole character that no piece ends with, written as bytes.
            closing = (data[j + 1, :k] & 0xC0) != 0x80 if j + 1 < longest else np.ones(k, dtype=bool)
            closing |= sizes[:k] == j + 1
            rows = np.flatnonzero(closing & bare)
            size = character[rows].astype(np.int32)
            score = best[j + 1 - size, rows] + self.unknown
            better = score > best[j + 1, rows]
            hit = rows[better]
            best[j + 1, hit] = score[better]
            piece[j + 1, hit] = -1
            width[j + 1, hit] = size[better]
        return order, sizes, data, best, piece, width

    def encode_stretches(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each stretch, one after the other, and how many each has."""
        order, sizes, data, _, piece, width = self._forward(stretches)
        m = len(stretches)
        # Back from the ends, all stretches together; pieces come out last first.
        position, rows = sizes.copy(), np.arange(m)
        found_rows, found_ids = [], []
        while len(rows):
            size = width[position[rows], rows].astype(np.int64)
            ids = piece[position[rows], rows]
            for back in range(1, 5):  # bytes of an unknown character
                byte = rows[(ids < 0) & (size >= back)]
                if len(byte):
                    found_rows.append(byte)
                    found_ids.append(self.byte_ids[data[position[byte] - back, byte]])
            known = ids >= 0
            found_rows.append(rows[known])
            found_ids.append(ids[known])
            position[rows] -= size
            rows = rows[position[rows] > 0]
        if not found_rows:
            return np.zeros(0, dtype=np.int32), np.zeros(m, dtype=np.int64)
        all_rows, all_ids = np.concatenate(found_rows)[::-1], np.concatenate(found_ids)[::-1]
        owner = order[all_rows]
        sort = np.argsort(owner, kind="stable")
        return all_ids[sort], np.bincount(owner, minlength=m)

    def _outputs(self, state: int) -> list[tuple[int, float, int]]:
        """Size, score and piece of all that ends at a state, the longest first."""
        found, at = [], int(self.first_output[state])
        while at >= 0:
            i = int(self.piece_at[at])
            found.append((int(self.depth[at]), float(self.scores[i]), i))
            at = int(self.output[at])
        return found

    def _read_on(self, data: bytes, best: list, piece: list, width: list, to: int) -> None:
        """Go on with the scores of a text, known up to the end of the lists, up to the position ``to``."""
        at = len(best) - 1
        moves, outputs = self.moves, self._ends
        state, begin = 0, max(0, at - self.longest)
        start = at
        while start > 0 and start < len(data) and data[start] & 0xC0 == 0x80:
            start -= 1
        for j in range(begin, to):
            byte = data[j]
            state = int(moves[state, byte])
            if j < at:
                continue
            if byte & 0xC0 != 0x80:
                start = j
            ends = outputs.get(state)
            if ends is None:
                ends = outputs[state] = self._outputs(state)
            most, chosen, size = -math.inf, -1, 0
            own, is_piece = j + 1 - start, False
            for length, score, i in ends:
                value = best[j + 1 - length] + score
                if value > most:
                    most, chosen, size = value, i, length
                is_piece = is_piece or length == own
            if not is_piece and (j + 1 == len(data) or data[j + 1] & 0xC0 != 0x80):
                value = best[start] + self.unknown
                if value > most:
                    most, chosen, size = value, -1, own
            best.append(most)
            piece.append(chosen)
            width.append(size)

    def _segments(self, stretch: bytes) -> list[tuple[int, int]]:
        """Overlapping segments of a stretch, cut between characters."""

        def boundary(at: int) -> int:
            while at < len(stretch) and stretch[at] & 0xC0 == 0x80:
                at += 1
            return min(at, len(stretch))

        overlap = max(OVERLAP, 3 * self.longest)
        begins = [boundary(a) for a in range(0, len(stretch), SEGMENT)]
        return [(a, boundary(a + SEGMENT + overlap)) for a in dict.fromkeys(begins) if a < len(stretch)]

    def _joins(self, known: np.ndarray, own: np.ndarray) -> tuple[int, float] | None:
        """First place of an overlap from which the scores ``own`` are those ``known`` but for a constant, and that."""
        both = np.isfinite(known) & np.isfinite(own)
        if not both.any():
            return None
        gap = np.where(both, known - np.where(both, own, 0.0), 0.0)
        changes = np.isfinite(known) != np.isfinite(own)
        at = np.flatnonzero(both)
        changes[at[1:]] |= np.diff(gap[at]) != 0
        last = np.maximum.accumulate(np.where(changes, np.arange(len(changes)), 0))
        good = (np.arange(len(changes)) - last >= self.longest) & both
        place = int(good.argmax())
        return (place, float(gap[place])) if good[place] else None

    def encode_long(self, stretches: list[bytes]) -> list[np.ndarray]:
        """Ids of each long stretch; equal to those of ``encode_stretches``."""
        parts = [(i, a, b) for i, stretch in enumerate(stretches) for a, b in self._segments(stretch)]
        known: list[tuple[list, list, list]] = [([0.0], [-1], [0]) for _ in stretches]
        size = max((b - a for _, a, b in parts), default=1)
        together = max(FEW_SEGMENTS, SEGMENT_CELLS // size)
        for first in range(0, len(parts), together):
            group = parts[first:first + together]
            # Only scores that are whole numbers add up to the same sums from another start.
            if len(group) < FEW_SEGMENTS or not self.whole:
                for i, _, b in group:
                    if b >= len(known[i][0]):
                        self._read_on(stretches[i], *known[i], b)
                continue
            order, sizes, _, best, piece, width = self._forward([stretches[i][a:b] for i, a, b in group])
            column = np.argsort(order)
            for (i, a, b), c in zip(group, column.tolist()):
                scores, pieces, widths = known[i]
                have = len(scores) - 1
                if b <= have:
                    continue
                if a == 0:
                    place, shift = 0, 0.0
                else:
                    found = self._joins(np.array(scores[a:have + 1]), best[:have - a + 1, c])
                    if found is None:
                        self._read_on(stretches[i], *known[i], b)
                        continue
                    place, shift = found
                # Places up to the known end agree with it; what is new comes from this segment.
                scores += (best[have - a + 1:b - a + 1, c] + shift).tolist()
                pieces += piece[have - a + 1:b - a + 1, c].tolist()
                widths += width[have - a + 1:b - a + 1, c].tolist()
        return [self._back(stretch, *found[1:]) for stretch, found in zip(stretches, known)]

    def _back(self, stretch: bytes, piece: list, width: list) -> np.ndarray:
        at, out = len(stretch), []
        while at > 0:
            size, i = width[at], piece[at]
            if i >= 0:
                out.append(i)
            else:
                out += [int(self.byte_ids[b]) for b in reversed(stretch[at - size:at])]
            at -= size
        return np.array(out[::-1], dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes that the ids stand for, without the space that encoding puts in front."""
        data = b"".join([self.surfaces[i] for i in ids.tolist()])
        return data[1:] if data[:1] == b" " else data


def read_model(path: str = MODEL) -> Pieces:
    """Pieces, scores and kinds of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)) for i in range(n)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Pieces(pieces, [model.get_score(i) for i in range(n)], plain, byte_ids)


def encode_batch(model: Pieces, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For steps of texts: all ids, and where each text's ids begin and the last end."""
    for texts in texts_of(column):
        # One text after the other, each with a space in front of it.
        m = len(texts.rows)
        lengths = np.diff(texts.starts)
        data = np.insert(texts.data, texts.starts[:-1][lengths > 0], np.uint8(32))
        starts = texts.starts + np.r_[0, np.cumsum(lengths > 0)]
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[starts[:-1][lengths > 0]] = True
        begins = np.flatnonzero(first)
        if not len(begins):
            yield np.zeros(0, dtype=np.int32), np.zeros(m + 1, dtype=np.int64)
            continue
        ends = np.r_[begins[1:], len(data)]
        hashes = span_hashes(data, begins, ends)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        whole = data.tobytes()

        def stretch_of(chosen: np.ndarray) -> list[bytes]:
            return [whole[a:b].replace(b" ", _MARK) for a, b in zip(begins[where[chosen]].tolist(), ends[where[chosen]].tolist())]

        places, counts, ids = model.encode_known(distinct, stretch_of)
        sizes = counts[back]
        total = np.r_[0, np.cumsum(sizes)]
        at = np.arange(total[-1]) + np.repeat(places[back] - total[:-1], sizes)
        yield ids[at], total[np.searchsorted(begins, starts)]


def _encode_distinct(model: Pieces, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Short stretches together in groups of bounded size, long ones by their segments."""
    sizes = np.array([len(s) for s in stretches])
    counts = np.zeros(len(stretches), dtype=np.int64)
    parts: list[np.ndarray | None] = [None] * len(stretches)
    short = np.flatnonzero(sizes <= LONG_STRETCH)
    short = short[np.argsort(sizes[short], kind="stable")]
    long = np.flatnonzero(sizes > LONG_STRETCH)
    for i, ids in zip(long.tolist(), model.encode_long([stretches[i] for i in long.tolist()])):
        parts[i], counts[i] = ids, len(ids)
    for group in (short[at:at + TOGETHER] for at in range(0, len(short), TOGETHER)):
        ids, n = model.encode_stretches([stretches[i] for i in group.tolist()])
        counts[group] = n
        for i, part in zip(group.tolist(), np.split(ids, np.cumsum(n)[:-1])):
            parts[i] = part
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32), counts


def _encode_task(model, with_ids: bool):
    names = ["n_tokens", "ids_sha256", "decodes"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model.value
        for batch in batches:
            kept = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
            at = 0
            column = batch.column("__text")
            for ids, starts in encode_batch(pieces, column):
                m = len(starts) - 1
                texts = column.slice(at, m)
                digests, exact = [], []
                for i, text in enumerate(texts.to_pylist()):
                    own = ids[starts[i]:starts[i + 1]]
                    digests.append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
                    exact.append(pieces.decode(own) == (text or "").replace(SPACE, " ").encode())
                columns = [pa.array(np.diff(starts)), pa.array(digests, pa.string()), pa.array(exact, pa.bool_())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(at, m) for i in kept] + columns, [batch.schema.names[i] for i in kept] + names)
                at += m

    return run


def encode_texts(docs: DataFrame, model: Pieces, id_: str = "doc_id", text: str = "text", keep: Sequence[str] = (),
                 with_ids: bool = True) -> DataFrame:
    """Token ids of each whole text, one row for each row of ``docs``.

    Returns ``doc_id``, the columns of ``keep``, ``n_tokens``, ``ids_sha256``
    (of the ids as 32-bit little-endian numbers), ``decodes`` (whether decoding
    the ids gives the text back) and, if ``with_ids``, ``ids``.  A space is put
    in front of each text, as the model has it; nothing else is normalised.  A
    null text counts as empty and has no ids.  A text that holds the space mark
    U+2581 itself decodes to a space there.  Null ids and repeated rows are
    kept.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kept = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(id_or_last(id_).alias("doc_id"), *kept, F.col(text).cast("string").alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    fields += [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decodes", BooleanType())]
    fields += [StructField("ids", ArrayType(IntegerType()))] * with_ids
    encoded = rows.mapInArrow(tidy(_encode_task(sent, with_ids)), StructType(fields))
    return encoded.withColumn("doc_id", id_or_null("doc_id")).withColumnsRenamed({f"__keep{i}": c for i, c in enumerate(keep)})


def decode_ids(rows: DataFrame, model: Pieces, id_: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Text of each list of ids: (doc_id, text); null ids give an empty text, broken UTF-8 the replacement character."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(np.asarray(v or [], dtype=np.int64)).decode("utf-8", "replace")
                     for v in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    picked = rows.select(F.col(id_).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, "doc_id long, text string")
