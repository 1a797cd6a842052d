"""Continuous ingest, search, access folding and maintenance.

Each micro-batch runs a batch plan on the latest stored version and writes the
next one: imports, searches and accesses write what they changed, maintenance
writes whole tables.  A version keeps the id of each stream, which lies in a
file beside the stream's checkpoint, and the number of its last batch.  A batch
that Spark delivers again after a failure finds its number and is skipped;
another stream, also one of the same kind, has an id of its own.  When another
writer was faster, the step is repeated on its version, so no update is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fadegraph.config import TOP_TOPICS, SearchConfig, SimilarityLimits
from fadegraph.operators.updates import AsOf, count_accesses, strengthen_topics
from fadegraph.plans.maintain import maintain
from fadegraph.plans.read import recall
from fadegraph.plans.write import AddVectors, remember_changes
from fadegraph.schema import Snapshot
from fadegraph.session import broadcast_if_small, cut_lineage
from fadegraph.sources.tables import Changes, Version, VersionConflict, load_snapshot, load_version, save_changes, save_snapshot

_INTERVAL_MINUTES = (1, 1440)
# Times that a batch tries to be the next version.
_ATTEMPTS = 20


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream of a checkpoint, made when it first starts."""
    path = f"{checkpoint}/memory-stream"
    try:
        return spark.read.text(path).first()[0]
    except AnalysisException:
        spark.createDataFrame([(uuid.uuid4().hex,)], "id string").coalesce(1).write.text(path)
        return spark.read.text(path).first()[0]


def _start(stream: DataFrame, path: str, checkpoint: str, step: Callable[[Version, DataFrame, int], Snapshot | Changes],
           **trigger) -> StreamingQuery:
    name = _stream_id(stream.sparkSession, checkpoint)

    def on_batch(batch: DataFrame, number: int) -> None:
        for attempt in range(_ATTEMPTS):
            version = load_version(batch.sparkSession, path)
            if version.batches.get(name, -1) >= number:
                return
            try:
                made = step(version, batch, number)
                if isinstance(made, Changes):
                    save_changes(made, version, (name, number))
                else:
                    save_snapshot(made, path, version, (name, number))
                return
            except VersionConflict:
                if attempt == _ATTEMPTS - 1:
                    raise

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def remember_stream(rows: DataFrame, path: str, checkpoint: str, add_vectors: AddVectors,
                    config: SearchConfig = SearchConfig(), as_of: AsOf = None,
                    limits: SimilarityLimits = SimilarityLimits(), **trigger) -> StreamingQuery:
    """Import a stream of topic-map rows (source_file, topic, ord, instance)."""

    def step(version: Version, batch: DataFrame, _: int) -> Changes:
        return remember_changes(version, batch, add_vectors, config, as_of, limits)

    return _start(rows, path, checkpoint, step, **trigger)


def recall_stream(queries: DataFrame, path: str, checkpoint: str, answers: str, config: SearchConfig = SearchConfig(),
                  top_k: int = TOP_TOPICS, as_of: AsOf = None, limits: SimilarityLimits = SimilarityLimits(),
                  **trigger) -> StreamingQuery:
    """Answer a stream of queries (query_id, query_embedding) into ``answers/batch=N``."""

    def step(version: Version, batch: DataFrame, number: int) -> Changes:
        recalled = recall(version.snapshot, batch, config, top_k, as_of=as_of, limits=limits)
        recalled.results.write.mode("overwrite").parquet(f"{answers}/batch={number}")
        return recalled.changes(version)

    return _start(queries, path, checkpoint, step, **trigger)


def access_changes(version: Version, log: DataFrame, boost: float = 0.1) -> Changes:
    """Topics that a log of accesses (topic_id, ts) strengthens; only parts that hold some are read."""
    hits = cut_lineage(count_accesses(log))
    known = version.read("topics", version.parts_of("topics", hits, "topic_id")).join(
        broadcast_if_small(hits.select(F.col("topic_id").alias("id"))), "id", "left_semi")
    return Changes(upserts={"topics": strengthen_topics(known, hits, boost)})


def access_stream(log: DataFrame, path: str, checkpoint: str, boost: float = 0.1, **trigger) -> StreamingQuery:
    """Fold a stream of accesses (topic_id, ts) into strength, count and half-life."""

    def step(version: Version, batch: DataFrame, _: int) -> Changes:
        return access_changes(version, batch, boost)

    return _start(log, path, checkpoint, step, **trigger)


def access_totals(log: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Accesses per topic and window of a stream, late rows up to ``delay`` included."""
    return log.withWatermark("ts", delay).groupBy(F.window("ts", window), "topic_id").agg(
        F.count(F.lit(1)).alias("n_accesses"), F.max("ts").alias("last_access"))


def maintain_once(spark: SparkSession, path: str, as_of: AsOf = None,
                  limits: SimilarityLimits = SimilarityLimits()) -> int:
    """One maintenance run on the latest snapshot; returns the new version."""
    return save_snapshot(maintain(load_snapshot(spark, path), as_of, limits), path)


def maintenance_stream(spark: SparkSession, path: str, checkpoint: str, interval_minutes: int = 10,
                       limits: SimilarityLimits = SimilarityLimits()) -> StreamingQuery:
    """Maintain every ``interval_minutes``, the first time at the start."""
    low, high = _INTERVAL_MINUTES
    if not low <= interval_minutes <= high:
        raise ValueError(f"the interval must be {low} to {high} minutes")

    def step(version: Version, _: DataFrame, __: int) -> Snapshot:
        return maintain(version.snapshot, None, limits)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return _start(ticks, path, checkpoint, step, processingTime=f"{interval_minutes} minutes")
