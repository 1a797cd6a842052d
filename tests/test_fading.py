"""Accesses and decay folded by a stream against a model that goes through time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fadegraph.operators.updates import decay_topics, weak_topics
from fadegraph.sources.tables import load_version, save_snapshot
from fadegraph.streaming import fading as fd
from tests.test_ingest_search import make

START = datetime(2024, 1, 1)
DELAY = timedelta(minutes=10)
TOPICS = "id string, strength double, access_count int, last_accessed timestamp_ntz, half_life_days double"


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, fd.STATE_STORE)
    yield
    spark.conf.set(name, before)


def faded(t, now):
    days = max((now - t["last"]).total_seconds(), 0) / 86_400
    return max(t["strength"] * 0.5 ** (days / t["half_life"]), 0.01)


def weak(t, now):
    return faded(t, now) < 0.05 and t["last"] < now - timedelta(days=30) and t["count"] < 5


def model(topics, batches):
    """What is left of each topic, and who was evicted, at the last watermark."""
    state = {i: dict(strength=s, count=c, last=a, half_life=h) for i, s, c, a, h in topics}
    mark, events = datetime(1970, 1, 1), []
    for batch in batches:
        events += [(at, t) for t, at in batch if at > mark]
        mark = max([mark] + [at - DELAY for _, at in batch])
    evicted = set()
    for at, t in sorted(events):
        if at > mark:
            continue
        if t in state and weak(state[t], at):
            evicted.add(t)
            del state[t]
        own = state.setdefault(t, dict(strength=1.0, count=0, last=at, half_life=7.0))
        own.update(strength=min(faded(own, at) + 0.1, 1.0), count=own["count"] + 1, half_life=own["half_life"] * 1.1, last=max(own["last"], at))
    gone = {t for t, own in state.items() if weak(own, mark)}
    return {t: own for t, own in state.items() if t not in gone}, evicted | gone, mark


def given(seed=5):
    rng = random.Random(seed)
    topics = [(f"t{i}", rng.choice([0.011, 0.06, 0.4, 1.0]), rng.randrange(6), START - timedelta(days=rng.randrange(60), seconds=i), 3.0 + i % 9)
              for i in range(40)]
    batches, at = [], START
    for _ in range(5):
        batch = []
        for _ in range(60):
            at += timedelta(seconds=rng.randrange(30_000))
            # Some rows come out of order, some too late.
            late = rng.choice([timedelta(0), timedelta(minutes=3), timedelta(minutes=3), timedelta(days=9)])
            batch.append(("t1" if rng.random() < 0.3 else f"t{rng.randrange(45)}", at - late))
        batches.append(batch)
    return topics, batches


def write(spark, folder, batch):
    spark.createDataFrame(batch, "topic_id string, ts timestamp_ntz").select(
        "topic_id", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def log(spark, folder):
    return spark.readStream.schema("topic_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def test_accesses_and_decay_in_the_order_of_time(spark, tmp_path):
    topics, batches = given()
    start = spark.createDataFrame(topics, TOPICS)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        fd.fading(log(spark, inbox), start).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    for batch in batches[:3]:
        write(spark, inbox, batch)
        run()  # each a start from the checkpoint of the one before
    for batch in batches[3:]:
        write(spark, inbox, batch)
    run()
    want, evicted, mark = model(topics, batches)
    rows = spark.read.parquet(out).collect()
    assert {r["topic_id"] for r in rows if r["is_evicted"]} == evicted and len(evicted) > 5
    last = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["is_evicted"], r["access_count"])):
        last[r["topic_id"]] = r
    untouched = {t: v for t, v in want.items() if t not in last}
    known = {t[0]: t for t in topics}
    for t, own in untouched.items():
        assert (own["strength"], own["count"]) == known[t][1:3]
    for t, r in last.items():
        if r["is_evicted"]:
            assert t not in want and r["at"] <= mark
        else:
            own = want.pop(t)
            assert (r["access_count"], r["last_accessed"]) == (own["count"], own["last"])
            assert r["strength"] == pytest.approx(own["strength"]) and r["half_life_days"] == pytest.approx(own["half_life"])
    assert set(want) == set(untouched)


def test_idle_topics_go_when_the_batch_operator_says(spark, tmp_path):
    topics, _ = given(6)
    start = spark.createDataFrame(topics, TOPICS)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for days in (0.5, 3, 11, 40, 90):
        clock = START + timedelta(days=days)
        # The clock of the stream is moved by accesses of another topic.
        write(spark, inbox, [("other", clock + DELAY)])
        fd.fading(log(spark, inbox), start).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        emitted = {r["topic_id"] for r in spark.read.parquet(out).collect() if r["is_evicted"]} - {"other"}
        batch = weak_topics(decay_topics(start, str(clock)), as_of=str(clock))
        assert emitted == {r["id"] for r in batch.collect()}


def test_evictions_cascade(spark, tmp_path):
    memory, inbox = str(tmp_path / "memory"), str(tmp_path / "in")
    snapshot = make(spark, [("a", [1.0, 0.0], 0.3), ("b", [0.0, 1.0], 0.02), ("c", [1.0, 1.0], 1.0)],
                    [("i1", "a", "x", [1.0, 0.0]), ("i2", "b", "y", [1.0, 0.0]), ("i3", "b", "z", [1.0, 0.0])],
                    [("a", "b", 0.5), ("b", "c", 0.5), ("a", "c", 0.5)])
    save_snapshot(snapshot.with_tables(topics=snapshot.topics.withColumn("last_accessed", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))),
                  memory, parts=4)
    write(spark, inbox, [("a", START + timedelta(days=2)), ("a", START + timedelta(days=4)), ("unknown", START + timedelta(days=30, minutes=20))])
    for _ in range(2):
        fd.fade_stream(log(spark, inbox), memory, str(tmp_path / "c")).awaitTermination()
    after = load_version(spark, memory)
    assert {r["id"]: r["access_count"] for r in after.snapshot.topics.collect()} == {"a": 2, "c": 0}
    assert [r["id"] for r in after.snapshot.instances.collect()] == ["i1"]
    assert [(r["from_topic"], r["to_topic"]) for r in after.snapshot.edges.collect()] == [("a", "c")]
