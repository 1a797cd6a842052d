"""Scores and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS_PER_DAY = 86_400_000_000


def elapsed_days(since: Column, now: Column) -> Column:
    """Days with their fraction."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return micros / F.lit(float(_MICROS_PER_DAY))


def whole_days(since: Column, now: Column) -> Column:
    """Whole days, cut toward zero."""
    return F.extract(F.lit("DAY"), now - since).cast("int")


def half_life_decay(value: Column, days: Column, half_life: Column) -> Column:
    return value * F.pow(F.lit(0.5), days / half_life)


def clamp_add(value: Column, gain: Column, cap: float = 1.0) -> Column:
    return F.least(value + gain, F.lit(cap))


def importance_score(idle_days: Column, relevance: Column, topic_distance: Column) -> Column:
    """Recency, relevance and distinctness, weighted 0.3, 0.4 and 0.3."""
    recency = F.exp(-idle_days / F.lit(30.0))
    distinct = F.least(topic_distance * F.lit(1.5), F.lit(1.0))
    return F.lit(0.3) * recency + F.lit(0.4) * relevance + F.lit(0.3) * distinct


def node_size(strength: Column, access_count: Column) -> Column:
    return strength * (F.lit(1.0) + F.log1p(access_count.cast("double")))


def instance_rank(similarity: Column, relevance: Column, importance: Column) -> Column:
    return similarity * relevance * importance


def dropout_draw(from_topic: Column, to_topic: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the edge and the seed alone.

    Unlike ``rand`` it is the same when a lost task is run again.
    """
    digest = F.md5(F.concat_ws("|", from_topic, to_topic, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def is_dropped(weight: Column, draw: Column, rate: float) -> Column:
    """Only edges lighter than 0.5 can be dropped."""
    return (weight < 0.5) & (draw < F.lit(rate))
