"""Jaccard join of texts on word shingles by grouped prefixes.

Texts are sets of hashed shingles.  In a global order that puts rare shingles
first, two sets of Jaccard similarity t or more share a shingle among their
first ``n - ceil(t * n) + 1`` ones, their prefixes.

1. Equal sets form a class and one member stands for it; classes of one size
   with identical prefixes form a group and one *leader* stands for that.
2. Leaders meet in buckets of the prefix shingles that more than one holds (a
   count-min sketch discards most of the others before anything is shuffled).
3. Each leader is compared with the first one of its bucket of about its size,
   each class with its leader; what links makes components.  A hot bucket of
   near copies is thereby mostly linked in as many comparisons as it has rows.
4. Pairs of a bucket that are still in different components are filtered within
   their task by size, place and parities (see below) and verified: first only
   so many as would join the components of a bucket, then all that are left.
   There groups are expanded: all members have the places of their leader.
   Pairs within a component would not change it.
5. Where links are counted too, all pairs of class representatives of each
   component, which hold every link, are compared in blocks, each pair once.

Parities of the members in each part of a set bound how far two sets differ
from below, so no link is lost to them.  Every verification intersects the two
whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.llm.shared import (
    Texts, binaries, id_or_last, id_or_null, mix, runs_hashes, signed, span_hashes, texts_of, tidy, write_out)
from fadegraph.llm.sketch import repeated_keys
from fadegraph.operators.components import connected_components
from fadegraph.session import broadcast_if_small

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Cells of the table of shingle counts that orders shingles, 8 MB.
_CELLS = 1 << 20
_PIECE = 1 << 16
_TOKEN_BITS = np.uint64(48)
PARITY_BITS = 1_024
LONG_PARITY_BITS = 16_384
# Rows of a bucket that are compared with one another in one group.
BLOCK_ROWS = 1_024
# Sets of a component, and members of theirs, that are compared with one another in one group where links are counted.
LINK_ROWS = 512
LINK_MEMBERS = 1 << 21
# Rows of a few numbers that may be broadcast, once counted.
MAX_BROADCAST = 500_000


def _shingles(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles: text number and hash, by text."""
    starts, ends, text = texts.words()
    words = span_hashes(texts.data, starts, ends, _LOWER)
    if not len(words):
        return text, words
    edges = np.searchsorted(text, np.arange(len(texts.rows) + 1))
    sizes = np.diff(edges)
    parts, owners = [], []
    if len(words) >= k:
        inside = np.flatnonzero(text[:len(text) - k + 1] == text[k - 1:])
        parts.append(runs_hashes(words, k)[inside])
        owners.append(text[inside])
    for i in np.flatnonzero((sizes > 0) & (sizes < k)):  # the whole sequence is the one shingle
        parts.append(mix(runs_hashes(words[edges[i]:edges[i + 1]], int(sizes[i])) + np.uint64(sizes[i])))
        owners.append(np.array([i]))
    owner, shingle = np.concatenate(owners), np.concatenate(parts)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    return owner[new], shingle[new]


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def _count_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_CELLS, dtype=np.int64)
        for batch in batches:
            for texts in texts_of(batch.column("text")):
                counts += np.bincount(_cell(_shingles(texts, k)[1]), minlength=_CELLS)
        if counts.any():
            n = _CELLS // _PIECE
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n), pa.int32()), binaries([p.astype(np.int32 if counts.max() < 2**31 else np.int64).tobytes()
                                                               for p in counts.reshape(n, _PIECE)])], ["piece", "counts"])

    return run


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the tasks' counts of each piece; pieces come in order, one is held at a time."""
    piece, total = None, np.zeros(_PIECE, dtype=np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            if row["piece"] != piece:
                if piece is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), binaries([total.tobytes()])], ["piece", "counts"])
                piece, total = row["piece"], np.zeros(_PIECE, dtype=np.int64)
            total += np.frombuffer(row["counts"], dtype=np.int32 if len(row["counts"]) == 4 * _PIECE else np.int64)
    if piece is not None:
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), binaries([total.tobytes()])], ["piece", "counts"])


def _shingle_counts(texts: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each cell occur, over all texts."""
    parts = texts.select("text").mapInArrow(tidy(_count_task(k)), "piece int, counts binary")
    merged = parts.repartition(_CELLS // _PIECE, "piece").sortWithinPartitions("piece").mapInArrow(
        tidy(_add_pieces), "piece int, counts binary")
    counts = np.zeros(_CELLS, dtype=np.int64)
    for row in merged.collect():  # _CELLS numbers
        counts[row["piece"] * _PIECE:][:_PIECE] = np.frombuffer(row["counts"], dtype=np.int64)
    return counts


def _prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _tokens48(shingles: np.ndarray) -> np.ndarray:
    """The six bytes of each shingle that a prefix keeps; equal ones stay equal."""
    return (mix(shingles) >> (np.uint64(64) - _TOKEN_BITS)).astype("<u8")


def _pack48(tokens: np.ndarray) -> bytes:
    return tokens.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _digests(owner: np.ndarray, shingle: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever the order of its members."""
    out = []
    for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        sums = np.zeros(n, dtype=np.uint64)
        if len(owner):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sums[owner[first]] = np.add.reduceat(mix(shingle ^ np.uint64(salt)), first)
        out.append(signed(sums))
    return out[0], out[1]


def _parities(owner: np.ndarray, shingle: np.ndarray, n: int, bits: int = PARITY_BITS) -> list[bytes]:
    """For each set, whether it has an odd number of members in each of ``bits`` parts.

    The bits in which two sets differ are never more than the members in which they do.
    """
    part = (mix(shingle ^ np.uint64(0x1D8E4E27C47D124F)) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(owner * bits + part, minlength=n * bits).astype(np.uint8).reshape(n, bits) & 1
    return [row.tobytes() for row in np.packbits(odd, axis=1)]


def _long_parities(owner: np.ndarray, shingle: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parities in more parts for the sets of more than ``PARITY_BITS`` members, nothing for the others."""
    out = [b""] * len(sizes)
    edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
    for i in np.flatnonzero(sizes > PARITY_BITS).tolist():
        part = shingle[edges[i]:edges[i + 1]]
        out[i] = _parities(np.zeros(len(part), dtype=np.int64), part, 1, LONG_PARITY_BITS)[0]
    return out


def _sign_task(k: int, percent: int, order):
    """One row for each text: size, digest and parities of its set, and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.searchsorted(np.array([2**i for i in range(63)]), order.value, side="right").astype(np.uint64)
        for batch in batches:
            ids = batch.column("did").to_numpy(zero_copy_only=False)
            for texts in texts_of(batch.column("text")):
                owner, shingle = _shingles(texts, k)
                m = len(texts.rows)
                sizes = np.bincount(owner, minlength=m)
                d1, d2 = _digests(owner, shingle, m)
                key = (ranks[_cell(shingle)] << np.uint64(58)) | (mix(shingle) >> np.uint64(6))
                sort = np.lexsort((key, owner))
                tokens = _tokens48(shingle[sort])
                firsts = np.cumsum(sizes) - sizes
                lengths = np.where(sizes > 0, _prefix_size(sizes, percent), 0)
                prefixes = [_pack48(np.ascontiguousarray(tokens[a:a + p])) for a, p in zip(firsts.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[texts.rows]), pa.array(sizes.astype(np.int64)), pa.array(d1), pa.array(d2), binaries(prefixes),
                     binaries(_parities(owner, shingle, m)), binaries(_long_parities(owner, shingle, sizes))],
                    ["did", "n", "d1", "d2", "prefix", "parity", "long_parity"])

    return run


def _set_task(k: int):
    """Digest and sorted members of the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column("text")):
                owner, shingle = _shingles(texts, k)
                m = len(texts.rows)
                d1, d2 = _digests(owner, shingle, m)
                edges = np.searchsorted(owner, np.arange(m + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1), pa.array(d2), binaries([shingle[edges[i]:edges[i + 1]].tobytes() for i in range(m)])],
                    ["d1", "d2", "members"])

    return run


def _prefix_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    joined = b"".join(batch.column("prefix").to_pylist())
    yield _unpack48(joined).astype(np.uint64)


def _posting_task(sketch):
    """One row for each prefix token that may be held twice: token, node, and size and place in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column("prefix").to_pylist()
            lengths = np.array([len(p) // 6 for p in prefixes], dtype=np.int64)
            tokens = _unpack48(b"".join(prefixes)).astype(np.uint64)
            places = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keep = sketch.value(tokens)
            nodes = np.repeat(batch.column("node").to_numpy(), lengths)[keep]
            sizes = np.repeat(batch.column("n").to_numpy(), lengths)[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(tokens[keep])), pa.array(nodes), pa.array(sizes), pa.array(places[keep])],
                ["token", "node", "n", "place"])

    return run


def _overlap_needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least common members of sets of these sizes for the similarity."""
    return -(-(na + nb) * percent // (100 + percent))


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _words(parities: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(parities.to_pylist()), dtype=np.uint64).reshape(len(parities), PARITY_BITS // 64)


def _parity_task(percent: int):
    """Pairs whose parities allow the overlap that the similarity needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            spare = na + nb - 2 * _overlap_needed(na, nb, percent)
            keep = _differing(_words(batch.column("pa")), _words(batch.column("pb"))) <= spare
            a, b = batch.column("la"), batch.column("lb")
            for i in np.flatnonzero(keep & (na > PARITY_BITS) & (nb > PARITY_BITS)).tolist():
                keep[i] = _differing(np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)) <= spare[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _merging(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of components, in order, join two that those before have not joined."""
    parent: dict[int, int] = {}
    keep = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent.get(x, x) != x:
            x = parent[x]
        while parent.get(y, y) != y:
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def _meet_task(percent: int, spanning: bool):
    """Candidate pairs of each block pair of a bucket that lie in different components.

    Rows come ordered by block pair, so one is held at a time.  With
    ``spanning`` only so many pairs are given as would join the components.
    """

    def pairs(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        i, j = rows["i"][0], rows["j"][0]
        left, right = np.flatnonzero(rows["side"] == i), np.flatnonzero(rows["side"] == j)
        none = np.zeros(0, dtype=np.int64)
        found_a, found_b = [none], [none]
        n, place, comp, node, parity = rows["n"], rows["place"], rows["comp"], rows["node"], rows["parity"]
        for at in range(0, len(left), 64):
            x = left[at:at + 64]
            na, nb = n[x][:, None], n[right][None, :]
            pa_, pb = place[x][:, None], place[right][None, :]
            need = _overlap_needed(na, nb, percent)
            good = (comp[x][:, None] != comp[right][None, :]) & (node[x][:, None] != node[right][None, :])
            if i == j:
                good &= x[:, None] < right[None, :]
            good &= np.minimum(pa_, pb) + 1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need
            good &= np.minimum(na, nb) >= need
            r, c = np.nonzero(good)
            if len(r):
                near = _differing(parity[x[r]], parity[right[c]]) <= (na + nb - 2 * need)[r, c]
                found_a.append(x[r[near]])
                found_b.append(right[c[near]])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if spanning and len(a):
            keep = _merging(comp[a], comp[b])
            a, b = a[keep], b[keep]
        return node[a], node[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def settle() -> pa.RecordBatch:
            a, b = pairs({c: np.concatenate([h[c] for h in held]) for c in held[0]})
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy() for c in ("token", "i", "j", "side", "node", "n", "place", "comp")}
            rows["parity"] = _words(batch.column("parity"))
            cuts = np.flatnonzero((np.diff(rows["token"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)) + 1
            for at, to in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist()):
                part = {c: v[at:to] for c, v in rows.items()}
                if held and any(held[0][c][0] != part[c][0] for c in ("token", "i", "j")):
                    yield settle()
                    held = []
                held.append(part)
        if held:
            yield settle()

    return run


def _verify_task(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("sa"), batch.column("sb")
            keep = []
            for x, y in zip(left, right):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = 0
                if len(a) and len(b):
                    at = np.searchsorted(a, b)
                    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _count_links_task(percent: int):
    """Links of the sets of each block pair of a component, weighted by the rows that the other set stands for.

    Rows come ordered by block pair, so one is held at a time.  Every pair is
    met in one block pair and decided by its two whole sets.
    """

    def counts(rows: dict[str, np.ndarray], members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        i, j = rows["i"][0], rows["j"][0]
        node, weight = rows["node"], rows["weight"]
        first = np.unique(node, return_index=True)[1]  # a text that is there twice gives its set twice
        left, right = first[rows["side"][first] == i], first[rows["side"][first] == j]
        found = np.zeros(len(node), dtype=np.int64)
        if len(left) and len(right):
            sizes = np.array([len(m) for m in members], dtype=np.int64)
            known, code = np.unique(np.concatenate([members[y] for y in right.tolist()]), return_inverse=True)
            code = code.astype(np.int32)
            starts = np.cumsum(sizes[right]) - sizes[right]
            for at, x in enumerate(left.tolist()):
                skip = at + 1 if i == j else 0
                if skip >= len(right):
                    continue
                spots = np.minimum(np.searchsorted(known, members[x]), len(known) - 1)
                held = np.zeros(len(known), dtype=bool)
                held[spots[known[spots] == members[x]]] = True
                common = np.add.reduceat(held[code[starts[skip]:]], starts[skip:] - starts[skip], dtype=np.int64)
                others = right[skip:]
                others = others[(100 * common >= percent * (sizes[x] + sizes[others] - common)) & (common > 0)]
                found[x] += weight[others].sum()
                found[others] += weight[x]
        return node[first], found[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("component", "i", "j", "side", "node", "weight")
        held: list[dict[str, np.ndarray]] = []
        sets: list[np.ndarray] = []

        def settle() -> pa.RecordBatch:
            nodes, links = counts({c: np.concatenate([h[c] for h in held]) for c in names}, sets)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links)], ["node", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy() for c in names}
            members = batch.column("members")
            cuts = np.flatnonzero((np.diff(rows["component"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)) + 1
            for at, to in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist()):
                part = {c: v[at:to] for c, v in rows.items()}
                if held and any(held[0][c][0] != part[c][0] for c in ("component", "i", "j")):
                    yield settle()
                    held, sets = [], []
                held.append(part)
                sets += [np.frombuffer(members[x].as_buffer(), np.uint64) for x in range(at, to)]
        if held:
            yield settle()

    return run


class _Join:
    """The tables of one join; ``signs`` has a row for each text."""

    def __init__(self, rows: DataFrame, signs: DataFrame, k: int, percent: int):
        self.rows, self.signs, self.k, self.percent = rows, signs, k, percent

    def similar_size(self, a: str, b: str) -> F.Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes that sizes and parities do not rule out."""
        signs = self.signs.select("node", "n", "parity", "long_parity")
        both = (pairs.join(signs.toDF("a", "na", "pa", "la"), "a").join(signs.toDF("b", "nb", "pb", "lb"), "b"))
        return both.mapInArrow(tidy(_parity_task(self.percent)), "a long, b long")

    def meeting(self, held: DataFrame, spanning: bool) -> DataFrame:
        """Candidate pairs of bucket rows (token, node, n, place, comp) in different components.

        The only pair of a bucket of two has been tried in the first round.
        """
        crowds = held.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
        crowds = crowds.filter("low < high and size > 2").select("token", F.ceil(F.col("size") / BLOCK_ROWS).alias("blocks"))
        rows = write_out(held.join(crowds, "token").withColumn("side", F.pmod(F.xxhash64("node"), "blocks")))
        there = rows.join(self.signs.select("node", "parity"), "node")
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
        dealt = there.withColumn("other", other).withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
        return (dealt.select("token", "i", "j", "side", "node", "n", "place", "comp", "parity").repartition("token", "i", "j")
                .sortWithinPartitions("token", "i", "j").mapInArrow(tidy(_meet_task(self.percent, spanning)), "a long, b long").distinct())

    def sets(self, wanted: DataFrame) -> DataFrame:
        """The rows (did, d1, d2, ...) of ``wanted`` with the members of their sets, one for each text that has the set."""
        dids = wanted.select("did").distinct()
        texts = self.rows.join(broadcast_if_small(dids, MAX_BROADCAST), "did", "left_semi").select("text")
        sets = texts.mapInArrow(tidy(_set_task(self.k)), "d1 long, d2 long, members binary")
        return sets.join(broadcast_if_small(wanted.drop("did"), MAX_BROADCAST), ["d1", "d2"])

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes whose whole sets are similar."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = write_out(self.signs.select("node", "did", "d1", "d2").join(broadcast_if_small(nodes, MAX_BROADCAST), "node"))
        sets = write_out(self.sets(wanted).select("node", "members"))
        both = (pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b"))
        return both.mapInArrow(tidy(_verify_task(self.percent)), "a long, b long").distinct()

    def link_counts(self, named: DataFrame, weights: DataFrame) -> DataFrame:
        """Rows that each node (node, component) is linked with but its own copies: (node, links).

        ``weights`` says of how many rows a node (node, weight) is one, if of more than itself.
        Links do not leave a component, so all its pairs are compared.
        """
        nodes = self.signs.select("node", "did", "d1", "d2", "n").join(broadcast_if_small(named, MAX_BROADCAST), "node")
        nodes = nodes.join(broadcast_if_small(weights, MAX_BROADCAST), "node", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
        nodes = write_out(nodes)
        crowds = nodes.groupBy("component").agg(F.ceil(F.greatest(
            F.count("*") / LINK_ROWS, F.sum("n") / LINK_MEMBERS)).alias("blocks"))
        wanted = write_out(nodes.join(broadcast_if_small(crowds, MAX_BROADCAST), "component").withColumn(
            "side", F.pmod(F.xxhash64("node"), "blocks")).drop("n"))
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
        dealt = self.sets(wanted).withColumn("other", other).withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
        return (dealt.select("component", "i", "j", "side", "node", "weight", "members").repartition("component", "i", "j")
                .sortWithinPartitions("component", "i", "j").mapInArrow(tidy(_count_links_task(self.percent)), "node long, links long")
                .groupBy("node").agg(F.sum("links").alias("links")))


def _named(links: DataFrame) -> DataFrame:
    """Component of each node of the links (a, b), numbered by one of its nodes."""
    found = connected_components(links.select(F.col("a").cast("string"), F.col("b").cast("string")))
    return found.select(F.col("node").cast("long"), F.col("component").cast("long"))


def similar_documents(docs: DataFrame, id_: str = "doc_id", text: str = "text", shingle_words: int = 5,
                      percent: int = 80, count_links: bool = False, number: bool = False) -> DataFrame:
    """Component of each text under links of Jaccard similarity ``percent / 100`` or more.

    Returns ``doc_id, n_shingles, component_id, mark``, one row for each row of
    ``docs``; ``mark`` is ``xxhash64`` of the text, which tells rows of one id
    apart.  ``component_id`` is the smallest id that links reach.  A-Z are
    lower-cased; words are runs without the six ASCII blanks.  A text of fewer
    words than ``shingle_words`` has its whole sequence as one shingle; a null
    or blank text has none and is linked with nothing, so its own id is its
    component (null for a null id; with links, a null id counts as the largest).
    With ``count_links`` a column ``n_links`` follows: the number of other rows,
    copies included, that the text of a row is linked with; it takes the
    comparison of all different sets of a component with one another.
    With ``number`` a column ``component`` follows, a number for each component;
    rows without ids, or of one id, may have one ``component_id`` in several.
    Other columns are dropped.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(id_or_last(id_).alias("did"), F.col(text).cast("string").alias("text"))
    order = spark.sparkContext.broadcast(_shingle_counts(rows, shingle_words))
    signed_rows = rows.withColumn("mark", F.xxhash64("text"))
    signs = write_out(
        signed_rows.mapInArrow(tidy(_with_mark(_sign_task(shingle_words, percent, order))),
                               "did long, n long, d1 long, d2 long, prefix binary, parity binary, long_parity binary, mark long")
        .withColumn("node", F.monotonically_increasing_id())
        .withColumn("g1", F.xxhash64("prefix", "n")).withColumn("g2", F.xxhash64("n", "prefix")))
    order.destroy()
    join = _Join(rows, signs, shingle_words, percent)

    # Equal sets, then identical prefixes: all but the first are set aside, narrow rows only.
    full = signs.filter("n > 0")
    classes = full.groupBy("d1", "d2", "n").agg(
        F.min(F.struct("did", "node")).alias("first"), F.count("*").alias("size")).filter("size > 1")
    copies = write_out(full.select("node", "d1", "d2", "n").join(classes, ["d1", "d2", "n"])
                       .filter("node <> first.node").select("node", F.col("first.node").alias("lead")))
    heads = full.join(broadcast_if_small(copies.select("node"), MAX_BROADCAST), "node", "left_anti")
    groups = heads.groupBy("g1", "g2", "n").agg(F.min("node").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    followers = write_out(heads.select("node", "g1", "g2", "n").join(groups, ["g1", "g2", "n"])
                          .filter("node <> lead").select("node", "lead", "n"))
    leaders = heads.join(broadcast_if_small(followers.select("node"), MAX_BROADCAST), "node", "left_anti")

    n_tokens = signs.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    sketch = spark.sparkContext.broadcast(repeated_keys(leaders.select("prefix"), _prefix_keys, n_tokens / 6))
    postings = leaders.select("node", "n", "prefix").mapInArrow(
        tidy(_posting_task(sketch)), "token long, node long, n long, place long")
    postings = postings.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100) / 2)))
    postings = write_out(postings)
    sketch.destroy()
    shared = postings.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1").select("token")
    buckets = write_out(postings.join(shared, "token"))

    # Round one: each with the first of its own and of the lower bands of sizes that can be similar.
    firsts = buckets.groupBy("token", "band").agg(F.min(F.struct("node", "n")).alias("first"))
    seats = firsts.select("token", F.explode(F.array("band", F.col("band") + 1, F.col("band") + 2)).alias("band"), "first")
    star = (buckets.join(seats, ["token", "band"]).filter(join.similar_size("n", "first.n"))
            .select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b"))
            .filter("a <> b").distinct())
    prefixed = followers.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
    tried = write_out(join.near(star.union(prefixed)))
    links = write_out(join.linked(tried))
    named = write_out(_named(links))

    def with_component(nodes: DataFrame, node: str, out: str) -> DataFrame:
        return nodes.join(broadcast_if_small(named, MAX_BROADCAST).withColumnsRenamed({"node": node, "component": out}), node, "left"
                          ).withColumn(out, F.coalesce(out, node))

    # Groups are expanded: followers take the places of their leader, and each group is a bucket of its own.
    seats = buckets.select("token", "node", "n", "place")
    seats = seats.unionByName(seats.withColumnRenamed("node", "lead").join(
        broadcast_if_small(followers.select("node", "lead"), MAX_BROADCAST), "lead").select("token", "node", "n", "place"))
    seats = seats.unionByName(followers.union(followers.select("lead", "lead", "n").distinct()).select(
        (-1 - F.col("lead")).alias("token"), "node", "n", F.lit(0).cast("long").alias("place")))
    # Later rounds: what buckets still hold in different components; first as much as would join them, then all.
    for spanning in (True, False):
        wide = join.meeting(with_component(seats, "node", "comp"), spanning).join(
            broadcast_if_small(tried, MAX_BROADCAST), ["a", "b"], "left_anti")
        wide = write_out(join.near(wide))
        links = write_out(links.union(join.linked(wide)))
        tried = tried.union(wide)
        named = write_out(_named(links))

    # A component takes the smallest id of all rows in it, copies included.
    named = write_out(_named(links))
    heads_of = signs.select("node", "did", "n", "mark").join(
        broadcast_if_small(copies, MAX_BROADCAST), "node", "left").withColumn("head", F.coalesce("lead", "node"))
    placed = with_component(heads_of, "head", "comp")
    lows = placed.join(
        broadcast_if_small(copies.select(F.col("lead").alias("comp")).union(named.select("component")).distinct(), MAX_BROADCAST),
        "comp", "left_semi").groupBy("comp").agg(F.min("did").alias("low"))
    found = placed.join(lows, "comp", "left")
    if count_links:
        weights = write_out(copies.groupBy(F.col("lead").alias("node")).agg((F.count("*") + 1).alias("weight")))
        counts = write_out(weights.join(join.link_counts(named, weights), "node", "full").select(
            F.col("node").alias("head"), (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links")))
        found = found.join(broadcast_if_small(counts, MAX_BROADCAST), "head", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return found.select(
        id_or_null("did").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("low", "did").alias("component_id"), "mark", *["n_links"] * count_links, *[F.col("comp").alias("component")] * number).withColumn(
        "component_id", id_or_null("component_id"))


def _with_mark(task):
    """The task's rows with the ``mark`` of their texts; a task gives one row for each text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in task(iter([batch])):
                yield pa.RecordBatch.from_arrays(
                    part.columns + [batch.column("mark").slice(at, part.num_rows)], part.schema.names + ["mark"])
                at += part.num_rows

    return run
