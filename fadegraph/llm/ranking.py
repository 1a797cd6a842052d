"""Quality scores of documents by Bradley-Terry ranking of preference pairs.

A document labelled good is preferred to one labelled bad.  The probability of
a preference is the logistic function of a weighted sum of the differences of
the two documents' features; the weights minimise the logistic loss over the
pairs, so the weighted sum of a document's own features is its score.  A
quantile of the scores, at the share of bad documents among the labelled ones,
is the threshold.

Every labelled document that is not held out is learned from.  They are dealt
to shards; in a shard pieces of good ones meet pieces of bad ones, each row of
a piece all of the other, so pairs grow with the rows.  Shards are fitted and
scored in tasks; of each, sums as wide as the features reach the driver.

Features describe the shape of the whole text (letter case, signs, repetition,
variety and length of words).  Ids, sources, languages and labels are no inputs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from fadegraph.llm.shared import Texts, id_or_last, id_or_null, span_hashes, texts_of, tidy, write_out

# Labelled rows of a shard, about; rows of a piece; and rows of the rarer label that a shard has at least, about.
SHARD_ROWS = 8_192
PIECE_ROWS = 128
LEAST_ROWS = 64
# Scores, and bins of them, among which a quantile is looked for in one step.
_BINS = 1_024
_FEW = 4_096
CUT = 0.3
# Bytes of text whose features are found in one step.
_STEP = 1 << 18

FEATURES = ("capitals", "signs", "digits", "stops", "wide", "sign_ends", "sign_words", "repeats", "same_as_second", "distinct",
            "log_distinct", "log_words", "word_length", "lines", "capital_words")
_SIGNS = frozenset(b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~")
_CLASS = np.zeros(256, dtype=np.int64)  # 0: lower case and blanks
_CLASS[65:91] = 1
_CLASS[sorted(_SIGNS)] = 2
_CLASS[48:58] = 3
_CLASS[list(b".,")] = 4
_CLASS[128:] = 5
_CLASS[10] = 6
_IS_SIGN = _CLASS == 2


def features_of(texts: Texts) -> np.ndarray:
    """A row of ``FEATURES`` for each text; an empty text has zeros."""
    m = len(texts.rows)
    owner = np.repeat(np.arange(m), np.diff(texts.starts))
    counts = np.bincount(owner * 7 + np.take(_CLASS, texts.data), minlength=7 * m).reshape(m, 7).astype(float)
    starts, ends, text = texts.words()
    n = np.bincount(text, minlength=m).astype(float)
    words = span_hashes(texts.data, starts, ends)
    size = counts.sum(axis=1) + 1.0

    def share(flags: np.ndarray, owners: np.ndarray) -> np.ndarray:
        return np.bincount(owners[flags], minlength=m) / np.maximum(n, 1.0)

    last, first = texts.data[ends - 1] if len(ends) else texts.data[:0], texts.data[starts] if len(starts) else texts.data[:0]
    next_, after = (words[1:] == words[:-1]) & (text[1:] == text[:-1]), (words[2:] == words[:-2]) & (text[2:] == text[:-2])
    order = np.lexsort((words, text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][new], minlength=m).astype(float)
    second = np.minimum(starts + 1, len(texts.data) - 1)
    capital = (_CLASS[first] == 1) & (_CLASS[texts.data[second]] == 1) if len(starts) else np.zeros(0, dtype=bool)
    out = np.column_stack([
        counts[:, 1] / size, counts[:, 2] / size, counts[:, 3] / size, counts[:, 4] / np.maximum(n, 1.0), counts[:, 5] / size,
        share(_IS_SIGN[last], text), share(_IS_SIGN[first], text), share(next_, text[1:]), share(after, text[2:]),
        distinct / np.maximum(n, 1.0), np.log1p(distinct), np.log1p(n),
        np.bincount(text, weights=ends - starts, minlength=m) / np.maximum(n, 1.0), counts[:, 6] / np.maximum(n, 1.0),
        share(capital, text)])
    out[n == 0] = 0.0
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights of standardised features, and the threshold that ``CUT`` stands for."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.centre) / self.scale) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``CUT`` at the threshold."""
        z = np.clip(self.raw(features) - self.threshold + np.log(CUT / (1 - CUT)), -30.0, 30.0)
        return 1.0 / (1.0 + np.exp(-z))


def _rows_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=float).reshape(-1, len(FEATURES))


def _pack_shard(table: pa.Table) -> pa.Table:
    """A shard's rows as two matrices, in an order that does not depend on tasks; its own rows come before those of other shards."""
    table = table.sort_by([("guest", "ascending"), ("place", "ascending"), ("lid", "ascending")]).combine_chunks()
    good, own = np.asarray(table.column("good")) == 1, np.asarray(table.column("guest")) == 0
    values = np.asarray(table.column("features").combine_chunks().flatten()).reshape(table.num_rows, -1)
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
                     "own_good": pa.array([int((good & own).sum())], pa.int64()), "own_bad": pa.array([int((~good & own).sum())], pa.int64()),
                     "good": pa.array([values[good].tobytes()], pa.binary()), "bad": pa.array([values[~good].tobytes()], pa.binary())})


def _shards_of(learned: DataFrame, n_good: int, n_bad: int, shard_rows: int) -> DataFrame:
    """Learned rows (lid, good, features) dealt to shards: (shard, own_good, own_bad, good, bad).

    A row belongs to one shard.  If a label is so rare that shards would lack
    it, its rows are guests of the next shards as well.
    """
    shards = max(1, math.ceil((n_good + n_bad) / shard_rows))
    rarer = 1 if n_good <= n_bad else 0
    copies = min(shards, math.ceil(LEAST_ROWS * shards / min(n_good, n_bad)))
    dealt = learned.withColumn("place", F.xxhash64("lid")).withColumn("guest", F.explode(
        F.sequence(F.lit(0), F.when(F.col("good") == rarer, F.lit(copies - 1)).otherwise(F.lit(0)))))
    at = dealt.select(F.pmod(F.col("place") + F.col("guest"), F.lit(shards)).cast("long").alias("shard"), "guest", "place", "lid", "good", "features")
    return at.groupBy("shard").applyInArrow(_pack_shard, "shard long, own_good long, own_bad long, good binary, bad binary")


def _sums_over(shards: DataFrame, sums_of: Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]) -> np.ndarray:
    """Sums over all shards of the numbers that ``sums_of`` finds for one, added in the order of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sums_of(_rows_of(r["good"]), _rows_of(r["bad"]), r["own_good"], r["own_bad"]).tolist() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(found, pa.list_(pa.float64()))], ["shard", "sums"])

    rows = shards.mapInArrow(run, "shard long, sums array<double>").collect()
    return np.sum([r["sums"] for r in sorted(rows, key=lambda r: r["shard"])], axis=0)


def _pair_sums(w: np.ndarray, centre: np.ndarray, scale: np.ndarray):
    """Gradient and Hessian of the logistic loss over a shard's pairs."""

    def sums_of(good: np.ndarray, bad: np.ndarray, own_good: int, own_bad: int) -> np.ndarray:
        gradient, hessian = np.zeros(len(w)), np.zeros((len(w), len(w)))
        x, y = (good - centre) / scale, (bad - centre) / scale
        many, few = -(-len(x) // PIECE_ROWS), -(-len(y) // PIECE_ROWS)
        for i in range(max(many, few) if many and few else 0):
            a, b = x[i % many * PIECE_ROWS:][:PIECE_ROWS], y[i % few * PIECE_ROWS:][:PIECE_ROWS]
            missed = 1.0 / (1.0 + np.exp(np.clip((a @ w)[:, None] - (b @ w)[None, :], -30.0, 30.0)))
            weight = missed * (1.0 - missed)
            across = a.T @ weight @ b
            gradient += a.T @ missed.sum(axis=1) - b.T @ missed.sum(axis=0)
            hessian += (a.T * weight.sum(axis=1)) @ a + (b.T * weight.sum(axis=0)) @ b - across - across.T
        return np.r_[gradient, hessian.ravel()]

    return sums_of


def _raw_task(ranking: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                good, bad = ranking.raw(_rows_of(r["good"])[:r["own_good"]]), ranking.raw(_rows_of(r["bad"])[:r["own_bad"]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[good, bad]), pa.array(np.r_[np.ones(len(good), np.int64), np.zeros(len(bad), np.int64)])], ["raw", "good"])

    return run


def _quantile(scored: DataFrame, share: float, mass_good: float, mass_bad: float) -> float:
    """Half way between the score (raw, good) at which the mass of the lowest reaches ``share`` and the next one.

    Exact: bins of the scores are counted and the one that holds it is cut into
    bins again, until few scores are left.
    """
    counts = [F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"), F.min("raw").alias("lo"), F.max("raw").alias("hi")]
    inside, below = scored, 0.0
    at = scored.agg(*counts).first()
    while at["good"] + at["bad"] > _FEW and at["lo"] < at["hi"]:
        lo, hi = at["lo"], at["hi"]
        inside = scored.filter(F.col("raw").between(F.lit(lo), F.lit(hi)))
        bin_ = F.least(F.floor((F.col("raw") - lo) / (hi - lo) * _BINS), F.lit(_BINS - 1))
        for at in sorted(inside.groupBy(bin_.alias("bin")).agg(*counts).collect(), key=lambda r: r["bin"]):
            if below + at["good"] * mass_good + at["bad"] * mass_bad >= share - 1e-9:
                break
            below += at["good"] * mass_good + at["bad"] * mass_bad
        inside = scored.filter(F.col("raw").between(F.lit(at["lo"]), F.lit(at["hi"])))
    values = sorted(inside.groupBy("raw").agg(*counts).collect(), key=lambda r: r["raw"])
    after = scored.filter(F.col("raw") > values[-1]["raw"]).agg(F.min("raw")).first()[0]
    for i, value in enumerate(values):
        below += value["good"] * mass_good + value["bad"] * mass_bad
        if below >= share - 1e-9:
            break
    above = values[i + 1]["raw"] if i + 1 < len(values) else after
    last = mass_bad if value["bad"] else mass_good
    if above is None or (value["good"] + value["bad"] > 1 and below - last >= share - 1e-9):
        return float(value["raw"])
    return float((value["raw"] + above) / 2)


def fit_shards(shards: DataFrame, n_good: int, n_bad: int, bad_share: float, ridge: float = 1.0) -> Ranking:
    """The ranking that prefers good rows of the shards to bad ones."""
    width = len(FEATURES)
    centre = _sums_over(shards, lambda x, y, n, m: x[:n].sum(axis=0) + y[:m].sum(axis=0)) / (n_good + n_bad)
    scale = np.sqrt(_sums_over(shards, lambda x, y, n, m: ((x[:n] - centre) ** 2).sum(axis=0) + ((y[:m] - centre) ** 2).sum(axis=0)) / (n_good + n_bad))
    scale = np.where(scale > 1e-9, scale, 1.0)
    w = np.zeros(width)
    for _ in range(25):  # Newton steps on the logistic loss
        sums = _sums_over(shards, _pair_sums(w, centre, scale))
        step = np.linalg.solve(sums[width:].reshape(width, width) + ridge * np.eye(width), sums[:width] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    scored = write_out(shards.mapInArrow(_raw_task(Ranking(centre, scale, w, 0.0)), "raw double, good long"))
    return Ranking(centre, scale, w, _quantile(scored, bad_share, (1.0 - bad_share) / n_good, bad_share / n_bad))


def _feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in texts_of(batch.column("text"), _STEP):
            found = features_of(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lid").slice(texts.rows[0], len(texts.rows)), pa.array(list(found), pa.list_(pa.float64()))], ["lid", "features"])


def held_out(id_: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_).cast("string")) % 5 == 0, F.lit(False))


def learn_ranking(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "quality",
                  shard_rows: int = SHARD_ROWS) -> Ranking:
    """Fit on all labelled rows that are not held out.

    Features are found before labels are joined, so no text is shuffled.
    Shares of labels are counted over all rows.  Ids without a label, with a
    null one or with both are not learned from.
    """
    known = write_out(
        labels.select(F.col(id_).alias("lid"), F.col(label).cast("int").alias("good")).dropna().filter(~held_out("lid"))
        .groupBy("lid").agg(F.min("good").alias("good"), F.max("good").alias("most")).filter("good = most").drop("most"))
    counts = known.agg(F.count("*").alias("n"), F.sum((F.col("good") == 0).cast("int")).alias("bad")).first()
    bad_share = (counts["bad"] or 0) / max(counts["n"], 1)
    rows = docs.select(F.col(id_).alias("lid"), F.col(text).cast("string").alias("text")).filter(F.col("lid").isNotNull() & ~held_out("lid"))
    schema = StructType([rows.schema["lid"], StructField("features", ArrayType(DoubleType()))])
    # One row for each id that is learned from, however often it is repeated.
    learned = write_out(rows.mapInArrow(tidy(_feature_task), schema).join(known.filter("good in (0, 1)"), "lid").groupBy("lid", "good").agg(
        F.min("features").alias("features")))
    counts = learned.agg(F.count("*").alias("n"), F.sum("good").alias("good")).first()
    n_good = counts["good"] or 0
    n_bad = counts["n"] - n_good
    if not n_good or not n_bad:
        return Ranking(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0)
    return fit_shards(write_out(_shards_of(learned, n_good, n_bad, shard_rows)), n_good, n_bad, bad_share)


def _score_task(ranking, text_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
            for texts in texts_of(batch.column(text_at), _STEP):
                score = ranking.value.score(features_of(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(texts.rows[0], len(texts.rows)) for i in kept]
                    + [pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                    [batch.schema.names[i] for i in kept] + ["score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "quality",
                  keep: Sequence[str] = (), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Quality of each whole text: doc_id, the columns of ``keep``, held_out, score, predicted; a row for each row.

    ``held_out`` rows (crc32 of the id as text divisible by 5) are never learned
    from.  ``predicted`` is 1 if ``score`` reaches ``CUT``.  A null text counts
    as empty and has a score as any other; a null id is not held out.  Without
    labels of both kinds all documents have the same score, ``CUT``.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ranking = spark.sparkContext.broadcast(learn_ranking(docs, labels, id_, text, label, shard_rows))
    kept = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    # A text that is kept goes to the tasks once.
    kept_text = text in keep and docs.schema[text].dataType == StringType()
    rows = docs.select(id_or_last(id_).alias("doc_id"), held_out(id_).alias("held_out"), *kept,
                       *([] if kept_text else [F.col(text).cast("string").alias("__text")]))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = StructType([*fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    scored = rows.mapInArrow(tidy(_score_task(ranking, f"__keep{list(keep).index(text)}" if kept_text else "__text")), schema)
    return scored.withColumn("doc_id", id_or_null("doc_id")).withColumnsRenamed({f"__keep{i}": c for i, c in enumerate(keep)})
