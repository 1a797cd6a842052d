"""Ranked lexical search by per-term geometric blocks.

Texts are cut into terms once; a document keeps its length and the counts of
those terms that some query asks for.  Documents lie in chunks, one after the
other in a task.  In a chunk each term's posting list is clustered by the
similarity of its documents: pivots are taken from the list, and every document
joins the most similar one in a random projection of the impact vectors.  A
cluster is a block, and its summary holds the largest impact of each coordinate
that a query with this term can ask for.

Terms are ranked by weight.  A query goes through its terms' lists from the
heaviest on.  A document that holds an earlier term was met in that term's list
(or lay in a block that could not matter), so in the list of term i only terms
from i on can add to a score, and a block is skipped only if its summary's
product with those is below the query's kth best score.  All other blocks are
scored exactly in whole numbers, so the result is that of scoring everything.

Queries are taken in groups of bounded size; a group's terms and weights are
what every task holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fadegraph.llm.shared import span_hashes, texts_of, tidy, write_out

# Pairs of query and term that are handled in one pass over the documents.
GROUP_PAIRS = 100_000
# Documents of a chunk, and cells of the matrix of a chunk's documents by terms.
CHUNK_ROWS = 2_048
CHUNK_CELLS = 8 << 20
# Documents of a block, on average; a shorter list is one block.
BLOCK_ROWS = 64
# Width of the projection that similarity is measured in.
PROJECTED = 32
# Bytes of a long text that are cut into terms at a time.
SLICE_BYTES = 4 << 20

# What separates terms, and the letters that are lower-cased.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Byte of a term in lower case, 0 for a separator.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _FOLD[_low:_high + 1] = 0


class Vocabulary:
    """Terms by hash; a match is decided by their bytes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        hashes = span_hashes(data, starts, starts + sizes)
        self.number = np.argsort(hashes, kind="stable")
        self.hashes, self.data = hashes[self.number], data
        self.starts, self.sizes = starts[self.number], sizes[self.number]
        self.same = int(np.unique(self.hashes, return_counts=True)[1].max()) if len(raw) else 0
        self.count = len(raw)

    def find(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans are terms, and of what number."""
        hashes = span_hashes(folded, starts, ends)
        first = np.searchsorted(self.hashes, hashes)
        spans, numbers = [], []
        for step in range(self.same):
            at = np.minimum(first + step, self.count - 1)
            hit = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == ends - starts) & (first + step < self.count))
            at, left = at[hit], np.arange(len(hit))
            good = np.ones(len(hit), dtype=bool)
            place = 0
            while len(left):
                left = left[self.sizes[at[left]] > place]
                wrong = folded[starts[hit[left]] + place] != self.data[self.starts[at[left]] + place]
                good[left[wrong]] = False
                left = left[~wrong]
                place += 1
            spans.append(hit[good])
            numbers.append(self.number[at[good]])
        return np.concatenate(spans), np.concatenate(numbers)


def _spans(folded: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each term."""
    inside = folded != 0
    edge = np.zeros(len(folded) + 1, dtype=bool)
    edge[starts] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def _cuts(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Slices of a long text between terms."""
    at = 0
    while at < len(data):
        to = min(at + size, len(data))
        if to < len(data):
            gaps = np.flatnonzero(_FOLD[data[at:to]] == 0)
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                while to < len(data) and _FOLD[data[to]]:
                    to += 1
        yield at, to
        at = to


def _count_task(vocabulary: Vocabulary, size: int) -> Callable:
    """(doc_id, text) to (doc_id, n, terms, counts)."""
    width = max(vocabulary.count, 1)

    def count(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, and the distinct (text, query term) with their counts."""
        folded = _FOLD[data]
        begin, end, text = _spans(folded, starts)
        total = np.bincount(text, minlength=len(starts) - 1)
        spans, numbers = vocabulary.find(folded, begin, end)
        keys, counts = np.unique(text[spans] * width + numbers, return_counts=True)
        return total, keys, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for step in texts_of(batch.column("text")):
                texts = len(step.rows)
                if texts == 1 and len(step.data) > size:
                    parts = [count(step.data[a:b], np.array([0, b - a])) for a, b in _cuts(step.data, size)]
                    total = np.array([sum(int(p[0][0]) for p in parts)])
                    keys, where = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
                    counts = np.bincount(where, weights=np.concatenate([p[2] for p in parts]), minlength=len(keys)).astype(np.int64)
                else:
                    total, keys, counts = count(step.data, step.starts)
                ends = pa.array(np.searchsorted(keys, np.arange(texts + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(step.rows)), pa.array(total.astype(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array((keys % width).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64)))], ["doc_id", "n", "terms", "counts"])

    return tidy(run)


@dataclass
class Asked:
    """Queries of a group: ranks of their terms, heaviest first, and the weights by rank."""

    weights: np.ndarray
    rank_of: np.ndarray
    queries: list[tuple[int, np.ndarray]]
    # By rank: the coordinates a summary of its blocks keeps.
    columns: dict[int, np.ndarray] = field(default_factory=dict)
    block_rows: int = BLOCK_ROWS

    def __post_init__(self) -> None:
        wanted: dict[int, list[np.ndarray]] = {}
        for _, ranks in self.queries:
            for i, r in enumerate(ranks.tolist()):
                wanted.setdefault(r, []).append(ranks[i:])
        self.columns = {r: np.unique(np.concatenate(parts)) for r, parts in wanted.items()}


class Chunk:
    """Some documents with the blocks of their posting lists, made when a query first asks for a list."""

    def __init__(self, impacts: np.ndarray, asked: Asked):
        self.impacts, self.asked = impacts, asked
        self.largest = impacts.max(axis=0).astype(np.int64)
        doc, rank = np.nonzero(impacts)
        order = np.argsort(rank, kind="stable")
        self.docs = doc[order]
        self.ends = np.searchsorted(rank[order], np.arange(impacts.shape[1] + 1))
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.places: np.ndarray | None = None

    def _near(self, docs: np.ndarray) -> np.ndarray:
        """The cluster of each document of a list, by the most similar of its pivots."""
        if self.places is None:
            spread = np.random.default_rng(11).normal(size=(self.impacts.shape[1], PROJECTED)).astype(np.float32)
            spread *= (self.asked.weights / max(self.asked.weights.max(), 1)).astype(np.float32)[:, None]
            places = self.impacts.astype(np.float32) @ spread
            self.places = places / np.maximum(np.sqrt((places * places).sum(axis=1, keepdims=True)), 1e-9)
        pivots = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // self.asked.block_rows)).astype(np.int64)]
        return (self.places[docs] @ self.places[pivots].T).argmax(axis=1)

    def list_of(self, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A term's documents block by block, where blocks start, and the summaries."""
        if rank not in self.blocks:
            docs, starts = self.docs[self.ends[rank]:self.ends[rank + 1]], np.zeros(1, dtype=np.int64)
            if len(docs) > self.asked.block_rows:
                near = self._near(docs)
                order = np.argsort(near, kind="stable")
                docs, near = docs[order], near[order]
                starts = np.concatenate([[0], np.flatnonzero(np.diff(near)) + 1])
            summary = np.maximum.reduceat(self.impacts[docs[:, None], self.asked.columns[rank]], starts, axis=0)
            self.blocks[rank] = docs, np.append(starts, len(docs)), summary.astype(np.int64)
        return self.blocks[rank]

    def search(self, ranks: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Documents that may be among the ``k`` best, with exact scores; those below ``floor`` are left out.

        Also the numbers of blocks that were scored and that were skipped.
        """
        weights = self.asked.weights[ranks]
        most = np.cumsum((weights * self.largest[ranks])[::-1])[::-1]
        met = np.zeros(len(self.impacts), dtype=bool)
        best, docs, scores, scored, skipped = np.zeros(0, dtype=np.int64), [], [], 0, 0
        for i, rank in enumerate(ranks.tolist()):
            if most[i] < floor:
                break
            if self.ends[rank] == self.ends[rank + 1]:
                continue
            own, starts, summary = self.list_of(rank)
            at = np.searchsorted(self.asked.columns[rank], ranks[i:])
            live = summary[:, at] @ weights[i:] >= floor
            scored, skipped = scored + int(live.sum()), skipped + int((~live).sum())
            own = own[np.repeat(live, np.diff(starts))]
            own = own[~met[own]]
            if not len(own):
                continue
            met[own] = True
            found = self.impacts[own[:, None], ranks].astype(np.int64) @ weights
            good = found >= floor
            docs.append(own[good])
            scores.append(found[good])
            best = np.sort(np.concatenate([best, found[good]]))[-k:]
            if len(best) == k:
                floor = max(floor, int(best[0]))
        if not docs:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), scored, skipped
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        good = scores >= floor
        return docs[good], scores[good], scored, skipped


def impact_matrix(n: np.ndarray, terms: np.ndarray, counts: np.ndarray, ends: np.ndarray, asked: Asked, docs: int, length: int) -> np.ndarray:
    """Saturated counts of documents by the ranks of the terms they hold."""
    sizes, which = np.unique(n, return_inverse=True)
    # 90 * n * N may pass 64 bits, its quotient does not.
    norms = np.array([100 - 90 + (90 * int(s) * docs) // length for s in sizes], dtype=np.int64)[which]
    doc = np.repeat(np.arange(len(n)), np.diff(ends))
    rank = asked.rank_of[terms]
    use = rank >= 0
    doc, rank, counts = doc[use], rank[use], counts[use]
    out = np.zeros((len(n), len(asked.weights)), dtype=np.int32)
    out[doc, rank] = (1_000_000_000 * counts) // (1_000 * counts + 8 * norms[doc])
    return out


def _search_task(asked: Asked, docs: int, length: int, k: int) -> Callable:
    """Documents with counts to the best of the task: (query, doc_id, score)."""
    rows = max(16, min(CHUNK_ROWS, CHUNK_CELLS // max(len(asked.weights), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By query: best scores, their ids, and whether an id is null; smaller ids first, null last.
        none = np.zeros(0, dtype=np.int64)
        best = {q: (none, none, none.astype(bool)) for q, _ in asked.queries}
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column("doc_id")
                unknown = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                terms, counts = part.column("terms"), part.column("counts")
                ends = terms.offsets.to_numpy().astype(np.int64)
                impacts = impact_matrix(
                    part.column("n").to_numpy(), terms.flatten().to_numpy(), counts.flatten().to_numpy(), ends, asked, docs, length)
                chunk = Chunk(impacts, asked)
                for query, ranks in asked.queries:
                    scores, owners, blank = best[query]
                    floor = max(int(scores[-1]), 1) if len(scores) == k else 1
                    found, values, _, _ = chunk.search(ranks, k, floor)
                    if len(found):
                        scores = np.concatenate([scores, values])
                        owners, blank = np.concatenate([owners, ids[found]]), np.concatenate([blank, unknown[found]])
                        order = np.lexsort((owners, blank, -scores))[:k]
                        best[query] = scores[order], owners[order], blank[order]
        queries = np.repeat(np.array(list(best), dtype=np.int64), [len(b[0]) for b in best.values()])
        if len(queries):
            scores, owners, blank = (np.concatenate(c) for c in zip(*best.values()))
            yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(owners, mask=blank), pa.array(scores)], ["query", "doc_id", "score"])

    return tidy(run)


def _terms_of(column: str) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.col(column).cast("string"), UPPER, LOWER), F.lit(f"[^{SEPARATORS}]+"), F.lit(0)))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """The ``k`` best documents of each item: (item_id, rank, doc_id, score).

    Terms are maximal runs of characters other than ASCII separators, A to Z in
    lower case; a text without terms has no part in the counts.  Scores are sums
    of whole numbers over an item's distinct terms and are above 0.  Equal
    scores go by ascending id, a null id last; documents that repeat an id are
    documents of their own, and so are items: each item row has ranks of its
    own, also with a null id.  Items without text or terms, or whose terms no
    document holds, have no rows.  Other columns are dropped.  Without documents
    or items the result is empty.

    The texts are read once for each ``group_pairs`` pairs of item and term.
    """
    spark = docs.sparkSession
    asked = write_out(items.select(F.monotonically_increasing_id().alias("query"), F.col(item_id).cast("long").alias("item_id"),
                                   _terms_of(item_text).alias("terms")).filter(F.size("terms") > 0))
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = -(-pairs // group_pairs)
    read = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for group in range(groups):
        own = asked.filter(F.pmod(F.xxhash64("query"), F.lit(groups)) == group)
        found = _rank_group(read, {r["query"]: r["terms"] for r in own.select("query", "terms").collect()}, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = out.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _rank_group(read: DataFrame, terms_of: dict[int, list[str]], k: int) -> DataFrame | None:
    """Best documents of each task for some queries: (query, doc_id, score); None if nothing can match."""
    if not terms_of:
        return None
    terms = sorted({t for own in terms_of.values() for t in own})
    number = {t: i for i, t in enumerate(terms)}
    counted = write_out(read.mapInArrow(_count_task(Vocabulary(terms), SLICE_BYTES), "doc_id long, n long, terms array<int>, counts array<bigint>"))
    docs, length = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not docs:
        return None
    holders = {r["term"]: r["holders"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("holders")).collect()}
    weight = {t: math.floor(1_000 * math.log((2 * docs + 2) / (2 * df + 1))) for t, df in holders.items()}
    order = sorted((t for t, w in weight.items() if w > 0), key=lambda t: (-weight[t], t))
    if not order:
        return None
    rank_of = np.full(len(terms), -1, dtype=np.int64)
    rank_of[order] = np.arange(len(order))
    queries = []
    for query, own in sorted(terms_of.items()):
        ranks = np.sort(rank_of[[number[t] for t in own]])
        ranks = ranks[ranks >= 0]
        if len(ranks):
            queries.append((query, ranks))
    group = Asked(np.array([weight[t] for t in order], dtype=np.int64), rank_of, queries, block_rows=BLOCK_ROWS)
    held = counted.filter(F.size("terms") > 0)
    return held.mapInArrow(_search_task(group, docs, length, k), "query long, doc_id long, score long")
