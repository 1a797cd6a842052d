"""Strength as a stream: accesses and decay in the order of time, and topics that are forgotten by themselves.

Boosts alone can be summed up, but between two accesses strength fades, so
accesses are folded one after the other, by event time.  The state of a topic
holds its strength and the accesses that the watermark has not passed; a timer
folds them once it has.  Another timer stands at the moment a topic becomes too
weak to keep, so an idle topic emits its own eviction.  What is emitted depends
on the events and the watermark, not on how events fall into batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fadegraph.session import broadcast_if_small, cut_lineage
from fadegraph.sources.tables import Changes, Version, load_version
from fadegraph.streaming.loops import _start

_MICROS_PER_DAY = 86_400_000_000
# Fixed values of decay and eviction.
_FLOOR, _WEAK, _IDLE_DAYS, _FEW_ACCESSES, _LENGTHENED = 0.01, 0.05, 30, 5, 1.1
# Fixed values of a new topic.
_NEW = (1.0, 0, 7.0)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_EMITTED = ("topic_id string, is_evicted boolean, at_micros long, strength double, access_count int, last_micros long, "
            "half_life_days double")


class _Topic:
    """Strength, accesses, last access and half-life of a topic."""

    def __init__(self, strength: float, count: int, last: int, half_life: float):
        self.strength, self.count, self.last, self.half_life = strength, count, last, half_life

    def faded(self, now: int) -> float:
        days = max(now - self.last, 0) / _MICROS_PER_DAY
        return max(self.strength * 0.5 ** (days / self.half_life), _FLOOR)

    def access(self, at: int, boost: float) -> None:
        """An access before the last one counts, but nothing fades between them."""
        self.strength = min(self.faded(at) + boost, 1.0)
        self.count, self.half_life, self.last = self.count + 1, self.half_life * _LENGTHENED, max(self.last, at)

    def weak_from(self) -> int | None:
        """The time after which the topic is weak, None if it never is."""
        if self.count >= _FEW_ACCESSES:
            return None
        days = self.half_life * math.log2(self.strength / _WEAK) if self.strength > _WEAK else 0.0
        return self.last + int(max(days, _IDLE_DAYS) * _MICROS_PER_DAY)

    def row(self, topic_id: str, is_evicted: bool, at: int) -> Row:
        return Row(topic_id=topic_id, is_evicted=is_evicted, at_micros=at, strength=self.strength, access_count=self.count,
                   last_micros=self.last, half_life_days=self.half_life)


class _Fading(StatefulProcessor):
    """The state of one topic; accesses wait until the watermark has passed them."""

    def __init__(self, boost: float):
        self.boost = boost

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.topic = handle.getValueState("topic", "strength double, count int, last long, half_life double")
        self.waiting = handle.getListState("waiting", "at long")
        self.timer = handle.getValueState("timer", "at long")

    def _stored(self) -> _Topic | None:
        return _Topic(*self.topic.get()) if self.topic.exists() else None

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.topic.update((initialState.strength, initialState.access_count, initialState.last_micros, initialState.half_life_days))
        self._set_timer(self._stored(), None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Spark lets rows pass that are behind this batch's watermark but not the last one's; they would be out of order.
        passed, first = timerValues.getCurrentWatermarkInMs() * 1_000, None
        for row in rows:
            if row.at_micros > passed:
                self.waiting.appendValue((row.at_micros,))
                first = row.at_micros if first is None else min(first, row.at_micros)
        self._set_timer(self._stored(), first, keep_earlier=True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1_000
        ready, later = [], []
        for (at,) in self.waiting.get():
            (ready if at <= now else later).append(at)
        topic = self._stored()
        for at in sorted(ready):
            end = topic and topic.weak_from()
            if end is not None and end < at:
                yield topic.row(key[0], True, end)
                topic = None
            topic = topic or _Topic(_NEW[0], _NEW[1], at, _NEW[2])
            topic.access(at, self.boost)
        end = topic and topic.weak_from()
        if end is not None and end < now:
            yield topic.row(key[0], True, end)
            topic = None
            self.topic.clear()
        elif ready:
            yield topic.row(key[0], False, topic.last)
            self.topic.update((topic.strength, topic.count, topic.last, topic.half_life))
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put([(at,) for at in later])
        self.timer.clear()
        self._set_timer(topic, min(later, default=None))

    def _set_timer(self, topic: _Topic | None, first_waiting: int | None, keep_earlier: bool = False) -> None:
        """One timer a topic, at the first thing that is due; timers count in milliseconds."""
        due = [at for at in (topic and topic.weak_from(), first_waiting) if at is not None]
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is not None and keep_earlier:
            due.append(old * 1_000)
        if not due:
            return
        at = max(min(due) // 1_000 + 1, 1)
        if old == at or (old is not None and keep_earlier and old <= at):
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


def fading(log: DataFrame, topics: DataFrame, delay: str = "10 minutes", boost: float = 0.1) -> DataFrame:
    """What becomes of topics under a stream of accesses (topic_id, ts): a row for each change.

    Gives (topic_id, is_evicted, at, strength, access_count, last_accessed,
    half_life_days); strength is that right after the topic's last access, of an
    evicted topic that of its last one, and ``at`` the time of the change.
    ``topics`` is the state before the first batch.  Accesses are folded in the
    order of ``ts`` once the watermark, ``delay`` behind the latest, has passed
    them; later ones are dropped.  A topic that is weak (faded below 0.05, idle
    over 30 days and accessed under 5 times) at the watermark is evicted.  A
    topic that ``topics`` does not hold, or that was evicted before, starts like
    a new one at its next access.

    Needs the state store of ``STATE_STORE``.  A topic's accesses that wait are
    in the memory of one task: those of ``delay`` and of one batch, which the
    source's options bound.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.select("topic_id", F.col("ts").cast("timestamp").alias("ts"), micros.alias("at_micros")).withWatermark("ts", delay)
    start = topics.select(F.col("id").alias("topic_id"), "strength", "access_count",
                          F.unix_micros(F.col("last_accessed").cast("timestamp")).alias("last_micros"), "half_life_days")
    out = rows.groupBy("topic_id").transformWithState(
        _Fading(boost), _EMITTED, "Append", "EventTime", initialState=start.groupBy("topic_id"))

    def stamp(name: str) -> F.Column:
        return F.timestamp_micros(name).cast("timestamp_ntz")

    return out.select("topic_id", "is_evicted", stamp("at_micros").alias("at"), "strength", "access_count",
                      stamp("last_micros").alias("last_accessed"), "half_life_days")


def last_changes(emitted: DataFrame) -> DataFrame:
    """The row of each topic's first eviction, or else its last row; what comes after an eviction is another topic."""
    columns = [c for c in emitted.columns if c != "topic_id"]
    last = F.max_by(F.struct(*columns), F.struct("is_evicted", F.when(F.col("is_evicted"), -F.unix_micros(F.col("at").cast("timestamp"))),
                                                 "at", "access_count"))
    return emitted.groupBy("topic_id").agg(last.alias("last")).select("topic_id", "last.*")


def fading_changes(version: Version, emitted: DataFrame) -> Changes:
    """What emitted rows change in the stored tables: strengths, and evicted topics with all that hangs on them."""
    last = cut_lineage(last_changes(emitted))
    values = last.filter("not is_evicted").select(
        F.col("topic_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("strength", "access_count", "last_accessed", "half_life_days")])
    held = version.read("topics", version.parts_of("topics", last, "topic_id"))
    kept = held.join(broadcast_if_small(values), "id").select(*[
        F.col(f"_{c}").alias(c) if f"_{c}" in values.columns else F.col(c) for c in held.columns])
    gone = broadcast_if_small(cut_lineage(last.filter("is_evicted").select(F.col("topic_id").alias("gone"))))
    instances = version.read("instances", version.parts_of("instances", gone, "gone")).join(
        gone, F.col("topic_id") == F.col("gone"), "left_semi").select("topic_id", "id")
    edges = version.read("edges").select("from_topic", "to_topic")
    links = edges.join(gone, F.col("from_topic") == F.col("gone"), "left_semi").unionByName(
        edges.join(gone, F.col("to_topic") == F.col("gone"), "left_semi"))
    return Changes(upserts={"topics": kept}, deletes={"topics": gone.select(F.col("gone").alias("id")), "instances": instances, "edges": links})


def fade_stream(log: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes", boost: float = 0.1, **trigger) -> StreamingQuery:
    """Keep a stored memory up to date with a stream of accesses (topic_id, ts): strengths, evictions and their cascade."""
    start = load_version(log.sparkSession, path).snapshot.topics
    return _start(fading(log, start, delay, boost), path, checkpoint, lambda version, batch, _: fading_changes(version, batch), **trigger)
