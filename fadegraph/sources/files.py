"""Whole text files of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F


def file_reader(spark: SparkSession, suffix: str | None = None) -> DataFrameReader:
    """A reader of a file or of a folder, of which it keeps the files whose name ends with ``suffix``."""
    reader = spark.read.option("recursiveFileLookup", "false")
    if suffix:
        escaped = "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in suffix)
        reader = reader.option("pathGlobFilter", "*" + escaped)
    return reader


def read_files(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """One row per file: (source_file, text).

    ``path`` is a file or a folder, which is not descended into; ``suffix``
    keeps the files whose name ends with it.  Files are identified, and hence
    ordered, by their path.
    """
    return file_reader(spark, suffix).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
