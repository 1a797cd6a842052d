import time

import pytest
from pyspark.sql import functions as F

from fadegraph import SearchConfig
from fadegraph.functions.embed import embed_hashed
from fadegraph.schema import empty_snapshot
from fadegraph.sources.tables import VersionConflict, latest_version, load_snapshot, load_version, save_snapshot
from fadegraph.streaming import loops
from tests.test_ingest_search import AS_OF, make

ROWS = "source_file string, topic string, ord long, instance string"


def hashed(df, column, out):
    return embed_hashed(df, column, 64, out)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_write_then_read(spark, tmp_path):
    memory, inbox, asked = (str(tmp_path / n) for n in ("memory", "inbox", "asked"))
    save_snapshot(empty_snapshot(spark), memory)
    put(spark, inbox, [("f1", "red apples", 0, "apples are red"), ("f1", "red apples", 1, "apples fall")], ROWS)
    loops.remember_stream(stream(spark, inbox, ROWS), memory, str(tmp_path / "c1"), hashed, as_of=AS_OF).awaitTermination()
    put(spark, inbox, [("f2", "apples red", 0, "apples are sweet"), ("f2", "blue water", 1, "water is wet")], ROWS)
    for _ in range(2):  # a second start finds nothing new
        loops.remember_stream(
            stream(spark, inbox, ROWS), memory, str(tmp_path / "c1"), hashed, as_of=AS_OF).awaitTermination()
    kept = load_snapshot(spark, memory)
    assert sorted(r["topic_name"] for r in kept.topics.collect()) == ["blue water", "red apples"]
    assert kept.instances.count() == 4

    queries = hashed(spark.createDataFrame([("q", "red apples")], "query_id string, text string"), "text", "query_embedding")
    queries.select("query_id", "query_embedding").coalesce(1).write.parquet(asked)
    answers = str(tmp_path / "answers")
    loops.recall_stream(stream(spark, asked, "query_id string, query_embedding array<float>"), memory,
                        str(tmp_path / "c2"), answers, SearchConfig(dropout_rate=0.0), as_of=AS_OF).awaitTermination()
    got = spark.read.parquet(answers).collect()
    assert [r["topic_name"] for r in got] == ["red apples"] and len(got[0]["contents"]) == 3
    after = {r["topic_name"]: r for r in load_snapshot(spark, memory).topics.collect()}
    assert after["red apples"]["access_count"] == 1


def accesses(spark, folder, topic, n):
    spark.createDataFrame([(topic,)] * n, "topic_id string").withColumn(
        "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)


ACCESS = "topic_id string, ts timestamp_ntz"


def counts(spark, memory):
    return {r["id"]: r["access_count"] for r in load_snapshot(spark, memory).topics.collect()}


def test_a_batch_is_applied_once(spark, tmp_path):
    memory, log, state = (str(tmp_path / n) for n in ("memory", "log", "state"))
    save_snapshot(make(spark, [("a", [1.0], 0.2), ("b", [1.0], 0.2)]), memory)
    accesses(spark, log, "a", 3)
    for _ in range(2):
        loops.access_stream(stream(spark, log, ACCESS), memory, state).awaitTermination()
        # Without the record of its end, Spark delivers the batch of this checkpoint again.
        for end in (tmp_path / "state" / "commits").glob("*0*"):
            end.unlink()
    after = {r["id"]: r for r in load_snapshot(spark, memory).topics.collect()}
    assert after["a"]["access_count"] == 3 and after["a"]["strength"] == pytest.approx(0.5)
    assert after["b"]["access_count"] == 0
    assert latest_version(spark, memory) == 2


def test_two_sources_of_a_kind(spark, tmp_path):
    memory = str(tmp_path / "memory")
    save_snapshot(make(spark, [("a", [1.0], 0.2), ("b", [1.0], 0.2)]), memory)
    for topic, n in (("a", 2), ("b", 5)):
        log = str(tmp_path / f"log-{topic}")
        accesses(spark, log, topic, n)
        loops.access_stream(stream(spark, log, ACCESS), memory, str(tmp_path / f"state-{topic}")).awaitTermination()
    assert counts(spark, memory) == {"a": 2, "b": 5}


def test_writers_at_the_same_time(spark, tmp_path):
    memory = str(tmp_path / "memory")
    save_snapshot(make(spark, [("a", [1.0], 0.2), ("b", [1.0], 0.2)]), memory)
    old = load_version(spark, memory)
    save_snapshot(old.snapshot, memory, old)
    with pytest.raises(VersionConflict):
        save_snapshot(old.snapshot, memory, old)
    running = []
    for topic, n in (("a", 4), ("b", 6)):
        log = str(tmp_path / f"log-{topic}")
        for _ in range(2):
            accesses(spark, log, topic, n)
        running.append(loops.access_stream(stream(spark, log, ACCESS), memory, str(tmp_path / f"state-{topic}")))
    for query in running:
        query.awaitTermination()
    assert counts(spark, memory) == {"a": 8, "b": 12}
    assert latest_version(spark, memory) == 6


def test_unchanged_tables_are_not_written(spark, tmp_path):
    memory, log = str(tmp_path / "memory"), str(tmp_path / "log")
    save_snapshot(make(spark, [("a", [1.0], 0.2)]), memory)
    before = load_version(spark, memory)
    accesses(spark, log, "a", 1)
    loops.access_stream(stream(spark, log, ACCESS), memory, str(tmp_path / "state")).awaitTermination()
    after = load_version(spark, memory)
    assert after.folders["topics"] != before.folders["topics"]
    assert {n: after.folders[n] for n in ("instances", "edges")} == {n: before.folders[n] for n in ("instances", "edges")}


def test_windowed_totals(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("a", "2024-01-30 00:10:00"), ("a", "2024-01-30 00:50:00"), ("b", "2024-01-30 01:10:00")]
    spark.createDataFrame(rows, "topic_id string, at string").select(
        "topic_id", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.parquet(log)
    totals = loops.access_totals(stream(spark, log, "topic_id string, ts timestamp"))
    query = totals.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(
        availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    got = {(r["topic_id"], r["window"]["start"].hour): r["n_accesses"] for r in spark.sql("select * from totals").collect()}
    assert got == {("a", 0): 2, ("b", 1): 1}


def test_maintenance_runs_at_the_start(spark, tmp_path):
    memory = str(tmp_path / "memory")
    save_snapshot(make(spark, [("a", [1.0, 0.0], 0.5), ("b", [0.0, 1.0], 0.5)], [], [("a", "b", 0.5), ("b", "a", 0.01)]), memory)
    with pytest.raises(ValueError):
        loops.maintenance_stream(spark, memory, str(tmp_path / "c"), 0)
    query = loops.maintenance_stream(spark, memory, str(tmp_path / "c"), 1440)
    deadline = time.monotonic() + 60
    while latest_version(spark, memory) < 2 and time.monotonic() < deadline:
        time.sleep(0.5)
    query.stop()
    edges = load_snapshot(spark, memory).edges.collect()
    assert [round(e["weight"], 6) for e in edges] == [0.475]
    assert loops.maintain_once(spark, memory, AS_OF) >= 3
