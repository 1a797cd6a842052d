"""Approximate nearest neighbours by cosine in a forest of hash prefixes.

Each tree gives a vector a string of ``BITS`` bits, the sides of random
hyperplanes it lies on; a tree is the array of those strings in sorted order.  A
query descends each tree to its longest matching prefix and then ascends all
trees together, one bit at a time, until the strings that match so far number
``candidates``; all vectors under one of these prefixes are compared exactly.

How many candidates are needed depends on the data, so a bounded sample of
queries is compared with every row, and the least number that finds
``recall`` of their true neighbours is taken.  Trees are cut by their first
bits into buckets and these into blocks of bounded size; a query that would
have to ascend above its bucket starts again from shorter bucket prefixes, down
to none, so every query gets its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fadegraph.llm.shared import write_out

TREES = 24
BITS = 62
BLOCK_ROWS = 4_096
# Queries that measure how many candidates are needed.
SAMPLE = 128
RECALL = 0.96
_SEED = 90_210


def hash_strings(x: np.ndarray) -> np.ndarray:
    """The string of each row in each tree, as a number of ``BITS`` bits, first bit highest."""
    planes = np.random.default_rng(_SEED + x.shape[1]).normal(size=(x.shape[1], TREES * BITS))
    powers = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    out = np.empty((len(x), TREES), dtype=np.int64)
    for at in range(0, len(x), 1_024):
        sides = (x[at:at + 1_024] @ planes > 0).reshape(-1, TREES, BITS)
        out[at:at + 1_024] = sides @ powers
    return out


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of strings."""
    return BITS - np.frexp((a ^ b).astype(float))[1]


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of each width: places in the batch and matrix."""
    sizes = np.asarray(column.value_lengths())
    for width in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == width)
        flat = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
        yield places, flat.reshape(len(places), width).astype(float)


def _hash_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.zeros((batch.num_rows, TREES), dtype=np.int64)
        for places, x in _matrices(batch.column("vec")):
            keys[places] = hash_strings(x)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TREES), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "keys"])


def _measure_task(sample):
    """For each sampled query: how many strings match so many bits, and its best rows with their longest match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, k = sample.value
        for batch in batches:
            owners = [np.asarray(i) for i in batch.column("ids").to_pylist()]
            for places, x in _matrices(batch.column("vec")):
                same = np.flatnonzero([len(v) == x.shape[1] for v in vectors])
                if not len(same):
                    continue
                q = np.array([vectors[i] for i in same], dtype=float)
                cosine = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
                mine, theirs = hash_strings(q), hash_strings(x)
                rows: list[tuple[int, int, int, float]] = []
                for i, s in enumerate(same.tolist()):
                    lengths = common_prefix(theirs, mine[i][None, :])
                    levels, counts = np.unique(lengths, return_counts=True)
                    rows += [(s, int(level), int(n), None) for level, n in zip(levels, counts)]
                    longest = lengths.max(axis=1)
                    for j in np.argsort(-cosine[i], kind="stable")[:k + 1].tolist():
                        others = len(owners[places[j]]) - int(ids[s] in owners[places[j]])
                        rows += [(s, int(longest[j]), None, float(cosine[i, j]))] * min(others, k)
                if rows:
                    s, level, n, cos = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s, pa.int32()), pa.array(level, pa.int32()), pa.array(n, pa.int64()), pa.array(cos, pa.float64())],
                        ["s", "level", "n", "cosine"])

    return run


def _needed(items: DataFrame, queries: DataFrame, k: int, recall: float) -> tuple[int, int]:
    """Candidates that find ``recall`` of the sampled queries' neighbours, and a depth most of them ascend to at most."""
    spark = items.sparkSession
    chosen = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE).collect()
    if not chosen:
        return 1, 0
    sample = spark.sparkContext.broadcast(([r["query_id"] for r in chosen], [list(r["vec"]) for r in chosen], k))
    seen = write_out(items.select("vec", "ids").mapInArrow(_measure_task(sample), "s int, level int, n long, cosine double"))
    counts = np.zeros((len(chosen), BITS + 1), dtype=np.int64)
    for row in seen.filter("n is not null").groupBy("s", "level").agg(F.sum("n").alias("n")).collect():
        counts[row["s"], row["level"]] += row["n"]
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # strings that match at least so many bits
    best = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("cosine"), F.desc("level")))
    near = seen.filter("n is null").withColumn("r", best).filter(F.col("r") <= k).select("s", "level").collect()
    at, level = np.array([r["s"] for r in near], dtype=int), np.array([r["level"] for r in near], dtype=int)
    most = int(above[:, 0].max(initial=1))
    m = 8 * k
    while m < most:
        depth = np.array([np.flatnonzero(row >= m).max(initial=0) for row in above])
        if not len(at) or (level >= depth[at]).mean() >= recall:
            break
        m = int(m * 1.25) + 1
    m = min(m, most)
    depth = np.array([np.flatnonzero(row >= m).max(initial=0) for row in above])
    return m, int(np.quantile(depth, 0.02))


def _ranges(keys: np.ndarray, wanted: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that match the first ``bits`` bits begin and end in the sorted array."""
    shift = BITS - bits
    low = (wanted >> shift) << shift
    return np.searchsorted(keys, low), np.searchsorted(keys, low + (np.int64(1) << shift))


def _count_group(prefix: int):
    """Matches of each query at each length from the bucket's on, in one block of one tree."""

    def run(items: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        keys, wanted = np.sort(items["key"].to_numpy()), visits["key"].to_numpy()
        parts = []
        left = np.arange(len(wanted))
        for bits in range(prefix, BITS + 1):
            low, high = _ranges(keys, wanted[left], np.int64(bits))
            some = high > low
            left = left[some]
            if not len(left):
                break
            parts.append(pd.DataFrame({"query_id": visits["query_id"].to_numpy()[left], "level": np.int32(bits), "n": (high - low)[some]}))
        return pd.concat(parts) if parts else pd.DataFrame(
            {"query_id": np.zeros(0, np.int64), "level": np.zeros(0, np.int32), "n": np.zeros(0, np.int64)})

    return run


def _best_group(k: int):
    """The nearest ``k`` among the strings that match each query's depth, in one block of one tree."""

    def run(items: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(items) or not len(visits):
            return none
        items = items.sort_values("key")
        keys = items["key"].to_numpy()
        widths = items["vec"].map(len).to_numpy()
        asked = visits["vec"].map(len).to_numpy()
        out = []
        for width in np.unique(asked):
            own, there = np.flatnonzero(asked == width), np.flatnonzero(widths == width)
            if not len(there):
                continue
            x = np.stack(items["vec"].to_numpy()[there]).astype(float)
            norms = np.sqrt((x * x).sum(axis=1))
            ids = items["ids"].to_numpy()[there]
            sizes = np.array([len(i) for i in ids])
            firsts, flat = np.cumsum(sizes) - sizes, np.concatenate(ids)
            for at in range(0, len(own), 256):
                rows = own[at:at + 256]
                q = np.stack(visits["vec"].to_numpy()[rows]).astype(float)
                qid = visits["query_id"].to_numpy()[rows]
                low, high = _ranges(keys[there], visits["key"].to_numpy()[rows], visits["depth"].to_numpy()[rows].astype(np.int64))
                scores = (q / np.sqrt((q * q).sum(axis=1))[:, None]) @ (x / norms[:, None]).T
                column = np.arange(len(there))
                scores[(column[None, :] < low[:, None]) | (column[None, :] >= high[:, None])] = -np.inf
                # The k-th best of these rows, one more for the query's own, and what rounding may hide.
                least = np.partition(scores, max(len(there) - k - 1, 0), axis=1)[:, max(len(there) - k - 1, 0)]
                r, c = np.nonzero((scores >= least[:, None] - 1e-12) & np.isfinite(scores))
                exact = (q[r] * x[c]).sum(axis=1) / (np.sqrt((q[r] * q[r]).sum(axis=1)) * norms[c])
                n = sizes[c]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                found = flat[np.repeat(firsts[c], n) + inner]
                r, exact = np.repeat(r, n), np.repeat(exact, n)
                other = found != qid[r]
                r, exact, found = r[other], exact[other], found[other]
                order = np.lexsort((found, -exact, r))
                r, exact, found = r[order], exact[order], found[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append(pd.DataFrame({"query_id": qid[r[keep]], "vec_id": found[keep], "score": exact[keep]}))
        return pd.concat(out) if out else none

    return run


def _by_tree(rows: DataFrame, prefix: int, *columns: str) -> DataFrame:
    """Strings by tree and bucket; vectors of each width have trees of their own."""
    spread = rows.select(*columns, F.size("vec").alias("_width"), F.posexplode("keys").alias("tree", "key"))
    return spread.withColumn("tree", F.col("tree") + F.col("_width") * TREES).drop("_width").withColumn(
        "bucket", F.shiftright("key", BITS - prefix) if prefix else F.lit(0).cast("long"))


def _meet(index: DataFrame, visits: DataFrame, sizes: DataFrame, kernel, schema: str, *carried: str) -> DataFrame:
    """Blocks of buckets and the queries that visit them, in groups of bounded size."""
    crowds = visits.groupBy("tree", "bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("slices"))
    cuts = sizes.join(crowds, ["tree", "bucket"])
    left = (index.join(cuts, ["tree", "bucket"]).withColumn("block", F.pmod(F.xxhash64("key", "h1"), "blocks"))
            .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))))
    right = (visits.join(cuts, ["tree", "bucket"]).withColumn("slice", F.pmod(F.xxhash64("query_id"), "slices"))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))))
    by = ("tree", "bucket", "block", "slice")
    return (left.select(*by, "key", *carried).groupBy(*by)
            .cogroup(right.drop("blocks", "slices").groupBy(*by)).applyInPandas(kernel, schema))


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, recall: float = RECALL, candidates: int | None = None,
            id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query by cosine: (query_id, rank, vec_id, score).

    Queries are the rows for which ``is_query``, a condition on ``vectors``,
    holds; candidates are all rows but the query's own; every row is indexed.
    ``candidates`` is the number of matching strings, over all trees, that a
    query ascends to; by default it is measured on ``SAMPLE`` queries so that
    ``recall`` of their neighbours are found.  Scores are cosines in double
    precision of the original vectors; ties go to the smaller id; a table of few
    rows gives all of them.  Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows without an id.  Vectors of
    different width do not meet.  Rows that repeat an id are one item, with the
    least of their vectors; equal vectors are indexed once.  Other columns are
    dropped.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    value = F.col(vector).cast("array<double>")
    usable = (F.col(id_).isNotNull() & value.isNotNull()
              & ~F.coalesce(F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
              & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False)))
    rows = (vectors.filter(usable).select(F.col(id_).cast("long").alias("vec_id"), is_query.alias("asks"), F.col(vector).alias("vec"))
            .groupBy("vec_id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")))
    rows = write_out(rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}))
    kind = rows.schema["vec"].dataType.simpleString()
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    items = rows.withColumn("place", rank).filter(F.col("place") <= k + 1).groupBy("h1", "h2").agg(
        F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    items = write_out(items.mapInArrow(_hash_task, f"h1 long, h2 long, vec {kind}, ids array<bigint>, keys array<bigint>"))
    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "vec")
    measured, prefix = _needed(items, queries, k, recall)
    wanted = measured if candidates is None else candidates
    waiting = write_out(queries.mapInArrow(_hash_task, f"query_id long, vec {kind}, keys array<bigint>"))
    found = None
    while True:
        index = _by_tree(items, prefix, "h1")
        sizes = write_out(index.groupBy("tree", "bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")))
        visits = _by_tree(waiting, prefix, "query_id")
        counts = _meet(index, visits, sizes, _count_group(prefix), "query_id long, level int, n long")
        enough = counts.groupBy("query_id", "level").agg(F.sum("n").alias("n")).filter(
            (F.col("n") >= wanted) | F.lit(prefix == 0) & (F.col("level") == 0))
        depths = write_out(enough.groupBy("query_id").agg(F.max("level").alias("depth")))
        ready = waiting.join(depths, "query_id")
        best = _meet(_by_tree(items, prefix, "h1", "vec", "ids"), _by_tree(ready, prefix, "query_id", "vec", "depth"), sizes,
                     _best_group(k), "query_id long, vec_id long, score double", "vec", "ids")
        found = best if found is None else found.unionByName(best)
        if prefix == 0:
            break
        waiting = write_out(waiting.join(depths, "query_id", "left_anti"))
        if waiting.isEmpty():
            break
        prefix = max(0, prefix - 4)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
