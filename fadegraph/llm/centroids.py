"""Centroid clustering in whole numbers with ns-bounds.

Every vector keeps, for each centroid, its distance when it was last evaluated
and the round of that evaluation.  The centroids of all rounds are kept, so a
stored distance is loosened by the norm of the centroid's whole displacement
since then, not by the sum of its steps, which can only be longer.  The same
number, loosened upwards, bounds the distance to the own centroid.  Centroids
whose loosened bound may reach the own one are evaluated again, in exact whole
numbers; the others are strictly farther.

Vectors are written once, in buckets by row number.  A round joins them with
the last round's bounds, which lie in the same buckets, so nothing is shuffled;
it writes new bounds only.  Sums for new centroids follow from the vectors that
changed cluster: each batch writes what it adds to and takes from them.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.llm.shared import tidy, write_out
from fadegraph.session import ensure_checkpoint_dir

# Vectors of a bucket, whose bounds a task holds in memory.
BUCKET_ROWS = 200_000
# Stored distances are rounded to single precision; bounds are loosened by this share more.
SLACK = 1e-6
_LONG = 2**63 - 1
# Pairs of vector and centroid that are evaluated at a time.
PAIRS = 1 << 14


class Buckets:
    """Tables in buckets by their column ``row``, in the shared checkpoint folder.

    Two of them join without a shuffle.  Leaving the block takes their names
    from the session's catalog; the files stay like those of other written tables.
    """

    def __init__(self, spark: SparkSession, count: int):
        self.spark, self.count, self.names = spark, count, []

    def __enter__(self) -> Buckets:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def write(self, df: DataFrame) -> DataFrame:
        name = f"buckets_{uuid.uuid4().hex}"
        self.names.append(name)
        path = f"{ensure_checkpoint_dir(self.spark)}/{name}"
        df.write.format("parquet").bucketBy(self.count, "row").option("path", path).saveAsTable(name)
        return self.spark.table(name)


def _is_plain(least: int, most: int, width: int) -> bool:
    """Whether squared distances of such components fit 64 bits."""
    return max(abs(least), abs(most)) <= math.isqrt(2**62 // max(width, 1)) // 2


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays as a matrix, of exact numbers of any size where components are large."""
    flat = np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), width)
    return flat if not flat.size or _is_plain(int(flat.min()), int(flat.max()), width) else flat.astype(object)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), type=kind))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return (gap * gap).sum(axis=1)


class History:
    """Centroids of all rounds, and how far each is now from where it was."""

    def __init__(self, rounds: list[list[list[int]]]):
        every = [x for c in rounds for v in c for x in v]
        plain = not every or _is_plain(min(every), max(every), len(rounds[0][0]))
        self.rounds = [np.array(c, dtype=np.int64 if plain else object) for c in rounds]
        self.now = self.rounds[-1]
        moved = [[float(sum((int(a) - int(b)) ** 2 for a, b in zip(v, w))) ** 0.5 for v, w in zip(c, self.now)] for c in self.rounds]
        # By round and centroid, rounded up.
        self.moved = np.array(moved) * (1 + SLACK)


def assign(x: np.ndarray, own: np.ndarray, seen: np.ndarray, stamp: np.ndarray, history: History) -> tuple[np.ndarray, int]:
    """The nearest centroid of each vector; ``seen`` and ``stamp`` are brought up to date.

    ``own`` is the last cluster, -1 for none yet.  Also returns the number of
    distances evaluated.
    """
    now, rows, k = len(history.rounds) - 1, np.arange(len(x)), len(history.now)
    own = own.copy()
    fresh = own < 0
    evaluated = 0
    exact = np.full(len(x), -1, dtype=object if x.dtype == object or history.now.dtype == object else np.int64)

    def evaluate(r: np.ndarray, j: np.ndarray) -> np.ndarray:
        nonlocal evaluated
        evaluated += len(r)
        out = [_squares(x[r[a:a + PAIRS]], history.now[j[a:a + PAIRS]]) for a in range(0, len(r), PAIRS)]
        squares = np.concatenate(out) if out else np.zeros(0, dtype=exact.dtype)
        seen[r, j] = np.sqrt(squares.astype(float))
        stamp[r, j] = now
        return squares

    def bounds() -> tuple[np.ndarray, np.ndarray]:
        """Least possible distances, and the largest possible one to the own centroid."""
        moved = history.moved[stamp, np.arange(k)]
        loose = (seen + moved) * SLACK
        return seen - moved - loose, (seen + moved + loose)[rows, np.maximum(own, 0)]

    least, most = bounds()
    unsure = least <= most[:, None]
    unsure[rows, np.maximum(own, 0)] = False
    open_ = np.flatnonzero(unsure.any(axis=1) & ~fresh)
    if len(open_):
        exact[open_] = evaluate(open_, own[open_])
        least, most = bounds()
        unsure &= least <= most[:, None]
    unsure[fresh] = True
    r, j = np.nonzero(unsure)
    squares = evaluate(r, j)
    # Smaller numbers come first, so among equal distances the first found stays.
    for c in range(k):
        at = j == c
        who, value = r[at], squares[at]
        better = (own[who] < 0) | (value < exact[who]) | ((value == exact[who]) & (c < own[who]))
        own[who[better]], exact[who[better]] = c, value[better]
    return own, evaluated


def _round_task(history: History, width: int) -> Callable:
    """Vectors with their last bounds to their new ones; the last row of a batch carries the changes of the sums."""
    k = len(history.now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _numbers(batch.column("vec"), width)
            if "cluster" in batch.schema.names:
                old = batch.column("cluster").to_numpy().astype(np.int64)
                seen = np.asarray(batch.column("seen").flatten(), dtype=np.float32).reshape(n, k).astype(float)
                stamp = np.asarray(batch.column("stamp").flatten(), dtype=np.int64).reshape(n, k)
            else:
                old, seen, stamp = np.full(n, -1), np.zeros((n, k)), np.zeros((n, k), dtype=np.int64)
            own, evaluated = assign(x, old, seen, stamp, history)
            moved = np.flatnonzero(own != old)
            change = np.zeros((k, width + 1), dtype=object)
            for c in range(k):
                for sign, who in ((1, moved[own[moved] == c]), (-1, moved[old[moved] == c])):
                    if len(who):
                        # In 64 bits a batch of plain components cannot overflow.
                        change[c, :width] += sign * x[who].sum(axis=0).astype(object)
                        change[c, width] += sign * len(who)
            changes = [None] * (n - 1) + [[int(v) for v in change.ravel()]]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array(own, type=pa.int32()),
                _lists(seen.astype(np.float32), pa.float32()), _lists(stamp, pa.int16()),
                pa.array(changes, type=pa.list_(pa.decimal128(38, 0))),
                pa.array([None] * (n - 1) + [evaluated], type=pa.int64())],
                ["row", "cluster", "seen", "stamp", "change", "evaluated"])

    return tidy(run)


_STATE = "row long, cluster int, seen array<float>, stamp array<smallint>, change array<decimal(38,0)>, evaluated long"


def _last_task(history: History, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _numbers(batch.column("vec"), width), batch.column("cluster").to_numpy()
            squares = np.concatenate([_squares(x[a:a + PAIRS], history.now[own[a:a + PAIRS]]) for a in range(0, len(x), PAIRS)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("cluster"), pa.array([min(int(s), _LONG) for s in squares], type=pa.int64())],
                ["vec_id", "cluster", "distance"])

    return tidy(run)


def _usable(vector: str, width: int) -> F.Column:
    value = F.col(vector).cast("array<double>")
    broken = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(value) == width) & ~broken, F.lit(False))


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024.0, width: int = 64, seed: int = 3,
                    id_: str = "vec_id", vector: str = "embedding", report: list[int] | None = None) -> DataFrame:
    """Clusters of whole-number vectors, ``floor(scale * x)``, after ``rounds`` rounds: one row a vector.

    Gives (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).
    Centroids start as the ``k`` vectors whose sha256 of ``seed:id`` is
    smallest (all vectors, if fewer); equal ids go by their vectors.  In each
    round every vector joins the nearest centroid by squared Euclidean distance,
    ties going to the smaller number, then every centroid that has vectors
    becomes their mean, rounded down.  Vectors join once more at the end.

    Vectors that are null, not ``width`` long, or hold null or non-finite
    components take no part, nor do rows without an id.  Rows that repeat an id
    are vectors of their own.  Components beyond 64 bits stop at the largest
    such number, and so do distances and their sums; they are compared exactly.
    Other columns are dropped.  An empty table gives an empty result.

    The driver holds the centroids of all rounds and the sums of one
    (``k * width`` numbers each).  ``report`` takes the number of distances
    evaluated in each round.
    """
    spark = vectors.sparkSession
    kept = write_out(vectors.filter(F.col(id_).isNotNull() & _usable(vector, width)).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_).cast("long").alias("vec_id"),
        F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * float(scale)).cast("long")).alias("vec")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = [list(r["vec"]) for r in kept.orderBy(order, "vec").limit(k).select("vec").collect()]
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string")
    k, past = len(start), [start]
    sums = np.zeros((k, width + 1), dtype=object)
    count = max(spark.sparkContext.defaultParallelism, -(-kept.count() // BUCKET_ROWS))
    with Buckets(spark, count) as buckets:
        rows = buckets.write(kept.repartition(count, "row"))
        state = None
        for number in range(rounds + 1):
            known = rows.select("row", "vec")
            if state is not None:
                known = known.join(state.select("row", "cluster", "seen", "stamp").hint("shuffle_hash"), "row")
            state = buckets.write(known.mapInArrow(_round_task(History(past), width), _STATE))
            if report is not None:
                report.append(state.agg(F.sum("evaluated")).first()[0])
            if number == rounds:
                break
            changes = (state.filter("change is not null").select(F.posexplode("change").alias("at", "value"))
                       .groupBy("at").agg(F.sum("value").alias("value")).collect())
            for change in changes:
                sums[change["at"] // (width + 1), change["at"] % (width + 1)] += int(change["value"])
            past.append([[int(s) // int(c[width]) for s in c[:width]] if c[width] else past[-1][j] for j, c in enumerate(sums)])
            if past[-1] == past[-2]:
                break  # no centroid moved, so no later round changes anything
        last = rows.select("row", "vec_id", "vec").join(state.select("row", "cluster").hint("shuffle_hash"), "row")
        out = write_out(last.mapInArrow(_last_task(History(past), width), "vec_id long, cluster int, distance long"))
    inertias = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    total = min(sum(int(r["sum"]) for r in inertias), _LONG)
    summary = spark.createDataFrame(
        [(r["cluster"], min(int(r["sum"]), _LONG), total,
          hashlib.sha256(",".join(str(x) for x in past[-1][r["cluster"]]).encode()).hexdigest()) for r in inertias],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(summary), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
