"""Tables of the graph memory, their defaults and their constraints."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

TOPICS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("topic_name", T.StringType(), False),
    T.StructField("topic_embedding", _VECTOR, False),
    T.StructField("strength", T.DoubleType(), False),
    T.StructField("access_count", T.IntegerType(), False),
    T.StructField("last_accessed", T.TimestampNTZType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("decay_rate", T.DoubleType(), False),
    T.StructField("half_life_days", T.DoubleType(), False),
    T.StructField("metadata", T.StringType(), False),
])

INSTANCES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("topic_id", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("content_embedding", _VECTOR, False),
    T.StructField("relevance_score", T.DoubleType(), False),
    T.StructField("importance", T.DoubleType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("last_accessed", T.TimestampNTZType(), False),
    T.StructField("metadata", T.StringType(), False),
])

EDGES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("from_topic", T.StringType(), False),
    T.StructField("to_topic", T.StringType(), False),
    T.StructField("weight", T.DoubleType(), False),
    T.StructField("edge_type", T.StringType(), False),
    T.StructField("activation_count", T.IntegerType(), False),
    T.StructField("last_activated", T.TimestampNTZType(), False),
    T.StructField("decay_rate", T.DoubleType(), False),
])

# The flat table of hand-managed vectors.
VECTORS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("topic", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("embedding", _VECTOR, False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])

# Column defaults (fixed values); timestamps default to the clock of the call.
_DEFAULTS = {
    "topics": {"strength": 1.0, "access_count": 0, "decay_rate": 0.1, "half_life_days": 7.0, "metadata": "{}"},
    "instances": {"relevance_score": 1.0, "importance": 0.5, "metadata": "{}"},
    "edges": {"weight": 1.0, "edge_type": "semantic", "activation_count": 0, "decay_rate": 0.05},
}
_SCHEMAS = {"topics": TOPICS, "instances": INSTANCES, "edges": EDGES}
# Columns that must lie in [0, 1].
UNIT_RANGE = {
    "topics": ("strength",),
    "instances": ("relevance_score", "importance"),
    "edges": ("weight",),
}


@dataclass(frozen=True)
class Snapshot:
    """One state of the memory.  Operators return a new one."""

    topics: DataFrame
    instances: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.topics.sparkSession

    def with_tables(self, **tables: DataFrame) -> "Snapshot":
        return replace(self, **tables)


def clock(as_of: str | Column | None) -> Column:
    """``as_of`` as a timestamp without zone; None is the time of this call.

    The time is fixed here and not by the query, so tables that are written by
    different jobs of one call agree.
    """
    if as_of is None:
        return F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    return F.lit(as_of).cast("timestamp_ntz")


def new_id(prefix: str, *parts: Column) -> Column:
    """A repeatable id from the parts that identify the row.

    A random id would change when a lost task is run again; a digest does not.
    """
    text = F.concat_ws("\u0001", F.lit(prefix), *[p.cast("string") for p in parts])
    return F.sha2(text, 256)


def complete(df: DataFrame, table: str, as_of: str | Column | None = None) -> DataFrame:
    """Add absent columns of ``table`` with their defaults, in table order.

    An absent timestamp takes the table's other timestamp when that one is
    present, else ``as_of``; an absent edge id is derived from its endpoints.
    Vectors of double stay so.
    """
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)
               and isinstance(f.dataType.elementType, T.DoubleType)}
    columns = []
    stamps = [f.name for f in _SCHEMAS[table] if isinstance(f.dataType, T.TimestampNTZType)]
    given = [s for s in stamps if s in df.columns]
    for field in _SCHEMAS[table]:
        if field.name in df.columns:
            value = F.col(field.name)
        elif field.name in _DEFAULTS[table]:
            value = F.lit(_DEFAULTS[table][field.name])
        elif field.name in stamps:
            value = F.col(given[0]) if given else clock(as_of)
        elif table == "edges" and field.name == "id":
            value = new_id("edge", F.col("from_topic"), F.col("to_topic"))
        else:
            raise ValueError(f"{table} needs column {field.name}")
        kind = T.ArrayType(T.DoubleType()) if field.name in doubles else field.dataType
        if isinstance(kind, T.ArrayType):
            kind = T.ArrayType(kind.elementType)
        columns.append(value.cast(kind).alias(field.name))
    return df.select(*columns)


def typed_like(target: DataFrame) -> list[Column]:
    """Columns in the order and types of ``target``."""
    kinds = {
        f.name: T.ArrayType(f.dataType.elementType) if isinstance(f.dataType, T.ArrayType) else f.dataType
        for f in target.schema.fields
    }
    return [F.col(name).cast(kind).alias(name) for name, kind in kinds.items()]


def empty_snapshot(spark: SparkSession) -> Snapshot:
    return Snapshot(*(spark.createDataFrame([], s) for s in (TOPICS, INSTANCES, EDGES)))


def range_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows of ``table`` with a score outside [0, 1]."""
    bad = F.lit(False)
    for name in UNIT_RANGE[table]:
        bad = bad | F.coalesce(~F.col(name).between(0.0, 1.0), F.lit(True))
    return df.filter(bad)


def key_violations(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once (primary key, unique edge)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def width_violations(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Rows whose vector is not ``width`` long."""
    return df.filter(F.coalesce(F.size(vector) != width, F.lit(True)))


def dangling(snapshot: Snapshot) -> DataFrame:
    """Rows that point to a topic that is not there: (table, row_id, topic_id)."""
    ids = snapshot.topics.select(F.col("id").alias("known_id"))
    refs = snapshot.instances.select(
        F.lit("instances").alias("table"), F.col("id").alias("row_id"), F.col("topic_id")
    )
    for end in ("from_topic", "to_topic"):
        refs = refs.unionByName(
            snapshot.edges.select(
                F.lit("edges").alias("table"),
                F.concat_ws("->", "from_topic", "to_topic").alias("row_id"),
                F.col(end).alias("topic_id"),
            )
        )
    return refs.join(ids, refs.topic_id == ids.known_id, "left_anti")


def violations(snapshot: Snapshot) -> DataFrame:
    """Counts of broken constraints: (check, n_rows), one row per check."""
    checks = [(f"{t}_range", range_violations(getattr(snapshot, t), t)) for t in UNIT_RANGE]
    checks += [(f"{t}_key", key_violations(getattr(snapshot, t), "id")) for t in ("topics", "instances")]
    checks += [
        ("edges_key", key_violations(snapshot.edges, "from_topic", "to_topic")),
        ("dangling", dangling(snapshot)),
    ]
    report = None
    for name, rows in checks:
        one = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("check"), "n_rows")
        report = one if report is None else report.unionByName(one)
    return report


def require_valid(df: DataFrame, table: str) -> DataFrame:
    """``df`` with scores checked as it is read; a bad row fails the query."""
    ok = F.lit(True)
    for name in UNIT_RANGE[table]:
        ok = ok & F.coalesce(F.col(name).between(0.0, 1.0), F.lit(False))
    message = F.concat(F.lit(f"{table}: value outside [0, 1] in row "), F.to_json(F.struct(*UNIT_RANGE[table])))
    return df.filter(F.when(ok, True).otherwise(F.raise_error(message).cast("boolean")))


def vector_width(df: DataFrame, vector: str) -> int | None:
    """Width of the vectors, None when there are none.  One bounded read."""
    row = df.filter(F.size(vector) > 0).select(F.size(vector).alias("width")).first()
    return None if row is None else row["width"]
