"""Topic maps: JSON objects of topic to list of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.operators.aggregate import topic_arrays
from fadegraph.session import broadcast_if_small, cut_lineage
from fadegraph.sources.files import read_files
from fadegraph.sources.json_parts import CHUNK_BYTES, split_json

# Positions that one topic of a file may take up.
_STRIDE = 1 << 31


def parse_topic_map(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of files (source_file, text), and what is not a list of texts.

    Entries: (source_file, entry_ord, topic, instances).  Quarantine:
    (source_file, entry_ord, topic, value).  Values are parsed one by one, so
    a bad one costs only itself.  A repeated key keeps its first place and
    takes its last value.
    """
    entries = F.map_entries(F.from_json("text", "map<string,string>"))
    listed = files.select("source_file", F.posexplode(entries).alias("at", "entry"))
    rows = listed.groupBy("source_file", F.col("entry.key").alias("topic")).agg(
        F.min("at").cast("long").alias("entry_ord"), F.max_by("entry.value", "at").alias("value"),
    ).withColumn("instances", F.from_json("value", "array<string>"))
    bad = F.col("instances").isNull() | ~F.col("value").startswith("[")
    good = rows.filter(~F.coalesce(bad, F.lit(True))).select("source_file", "entry_ord", "topic", "instances")
    quarantine = rows.filter(F.coalesce(bad, F.lit(True))).select("source_file", "entry_ord", "topic", "value")
    return good, quarantine


def topic_map_rows(entries: DataFrame) -> DataFrame:
    """Entries as rows (source_file, topic, ord, instance)."""
    return entries.select(
        "source_file", "topic", "entry_ord", F.posexplode("instances").alias("at", "instance")).select(
        "source_file", "topic", (F.col("entry_ord") * F.lit(_STRIDE) + F.col("at")).alias("ord"), "instance")


def read_topic_map(spark: SparkSession, path: str, suffix: str | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_topic_map(read_files(spark, path, suffix))


def split_topic_map(spark: SparkSession, path: str, suffix: str | None = None,
                    chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows (source_file, topic, ord, instance) of files that may be larger than a task, and their quarantine.

    The rows of ``topic_map_rows`` and the quarantine of ``parse_topic_map``
    for well-formed files; no list of a topic is gathered.  A file whose
    brackets do not close, or without members, gives nothing.
    """
    files, members, items = split_json(spark, path, suffix, chunk_bytes)
    whole = members.join(files.filter("not is_broken"), "source_file", "left_semi")
    topics = cut_lineage(whole.groupBy("source_file", F.col("key").alias("topic")).agg(
        F.min("entry_ord").alias("first_ord"), F.max("entry_ord").alias("entry_ord"),
        F.max_by("is_listed", "entry_ord").alias("is_listed"), F.max_by(F.struct("value"), "entry_ord")["value"].alias("value")))
    text = F.get(F.from_json(F.concat(F.lit("["), "item", F.lit("]")), "array<string>"), F.lit(0))
    rows = items.filter("position is not null").join(
        broadcast_if_small(topics.filter("is_listed").drop("value")), ["source_file", "entry_ord"]).select(
        "source_file", "topic", (F.col("first_ord") * F.lit(_STRIDE) + F.col("position")).alias("ord"), text.alias("instance"))
    quarantine = topics.filter("not is_listed").select("source_file", F.col("first_ord").alias("entry_ord"), "topic", "value")
    return rows, quarantine


def write_topic_map(rows: DataFrame, path: str) -> None:
    """One JSON line {topic: [texts]} per topic, or per chunk of a large one.

    Each line is a topic map by itself, so ``read_topic_map_lines`` and any
    reader of the object form understand it.
    """
    arrays = topic_arrays(rows)
    line = F.to_json(F.map_from_arrays(F.array("topic"), F.array("instances")))
    arrays.select("source_file", "first_ord", line.alias("value")).repartitionByRange(
        "source_file", "first_ord").sortWithinPartitions("source_file", "first_ord").select("value").write.text(path)


def read_topic_map_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Topic maps kept one per line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    return parse_topic_map(lines)
