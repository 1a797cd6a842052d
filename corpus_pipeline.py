"""Stages that turn raw documents into encoded training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.llm import jaccard, mixing, pieces, ranking, secret_scan
from fadegraph.llm.shared import id_or_last, write_out
from fadegraph.session import broadcast_if_small

NEAR_WORDS, NEAR_PERCENT = 5, 80
SECRET_MARK = "[SECRET]"
# Rows of an id and a digest that may be broadcast, once counted.
MAX_BROADCAST = 500_000


def _carried(docs: DataFrame, *but: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns but some under names that clash with nothing, and what they were called."""
    names = {f"__c{i}": c for i, c in enumerate(docs.columns) if c not in but}
    return docs.select("doc_id", F.col("text").alias("__read"), *[F.col(c).alias(n) for n, c in names.items()]), names


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, names = _carried(docs)
    text = next(n for n, c in names.items() if c == "text")
    scored = ranking.score_quality(rows, labels, text=text, keep=tuple(names))
    return scored.filter("predicted = 1").select(*[F.col(n).alias(c) for n, c in names.items()])


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id and then mark, of each group of near duplicates.

    A null id counts as the largest.  Rows repeated with the same id and text are one document.
    """
    found = write_out(jaccard.similar_documents(docs, shingle_words=NEAR_WORDS, percent=NEAR_PERCENT, number=True).select(
        F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "component"))
    place = F.struct(id_or_last("__id").alias("id"), F.col("__mark").alias("mark"))
    groups = write_out(found.groupBy("component").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark"))
    gone = found.join(broadcast_if_small(groups.select("component", "first"), MAX_BROADCAST), "component").filter(
        place != F.col("first")).select("__id", "__mark").distinct()
    left = docs.join(broadcast_if_small(gone, MAX_BROADCAST), same, "left_anti")
    repeated = write_out(found.groupBy("__id", "__mark").agg(F.count("*").alias("n")).filter("n > 1").select("__id", "__mark"))
    if repeated.isEmpty():
        return left
    few = broadcast_if_small(repeated, MAX_BROADCAST)
    return left.join(few, same, "left_anti").unionByName(left.join(few, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    rows, names = _carried(docs, "text", "n_chars")
    clean = secret_scan.find_secrets(rows, text="__read", keep=tuple(names), redact_with=SECRET_MARK)
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    back = {c: n for n, c in names.items()}
    return clean.select(*[(F.col(back[c]) if c in back else new[c]).alias(c) for c in docs.columns])


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_mix(docs, weights=(5, 2, 1), share=1.5, limit=2.0)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return pieces.encode_texts(docs, pieces.read_model(), keep=("lang", "source", "n_chars"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near),
    ("secret scans", redact_secrets),
    ("mixing to weights", mix_to_weights),
    ("piece encoding", encode_pieces),
]

# Trained scores, random rounding and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
