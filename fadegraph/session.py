"""Session set-up and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of ids and numbers, without texts or vectors, that may be broadcast.
NARROW_ROWS = 200_000


def build_session(app_name: str = "fadegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution is what splits skewed join partitions, so it is set
    here even though it is also Spark's default.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Cut lineages are deleted once nothing refers to them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``.  Only a local session that
    names none gets a temporary one; on a cluster a machine-local folder would
    not survive the loss of an executor, so there it is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="fadegraph-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the checkpoint folder; unlike a cut lineage, columns of it are read alone."""
    place = f"{ensure_checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def broadcast_if_small(rows: DataFrame, max_rows: int = NARROW_ROWS) -> DataFrame:
    """``rows`` with a broadcast hint if they were counted and are few.

    For narrow rows behind ``cut_lineage``, where counting is cheap.  Beyond
    the bound Spark is left to shuffle both sides of the join.
    """
    return F.broadcast(rows) if rows.limit(max_rows + 1).count() <= max_rows else rows
