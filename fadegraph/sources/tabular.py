"""Any table as a topic map: the first column is the topic, the others its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.functions.text import cell_text, is_truthy


def tabular_rows(df: DataFrame, order_by: str | None = None, max_samples: int | None = None,
                 source: str = "table") -> DataFrame:
    """Topic-map rows (source_file, topic, ord, instance) of a table.

    A row counts when its topic is truthy and its cells, joined, are not
    blank; then every cell that is not null is an instance, empty ones
    included.  ``order_by`` names a unique integer column that gives the rows
    their order and is not content; without it rows are numbered as they are
    read.  ``max_samples`` takes the first rows of that order.
    """
    columns = [c for c in df.columns if c != order_by]
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "source_file string, topic string, ord long, instance string")
    topic, cells = columns[0], columns[1:]
    numbered = df.withColumn(
        "_ord", F.monotonically_increasing_id() if order_by is None else F.col(order_by).cast("long"))
    if max_samples:
        numbered = numbered.orderBy("_ord").limit(max_samples)
    texts = F.array_compact(F.array(*[cell_text(F.col(c)) for c in cells]))
    # Stripped texts joined by blanks are blank only when every one is empty.
    usable = is_truthy(F.col(topic), df.schema[topic].dataType) & F.exists("_texts", lambda t: t != "")
    kept = numbered.withColumn("_texts", texts).filter(usable & (cell_text(F.col(topic)) != ""))
    return kept.select(
        F.lit(source).alias("source_file"), cell_text(F.col(topic)).alias("topic"), "_ord",
        F.posexplode("_texts").alias("_at", "instance"),
    ).select("source_file", "topic", (F.col("_ord") * F.lit(len(cells)) + F.col("_at")).alias("ord"), "instance")
