"""Text to vector.

An embedder is a callable from a list of texts to an equally long list of
vectors.  It runs on the executors, one call per Arrow batch, so a remote or
local model is called in batches and never from the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed_with(df: DataFrame, text: str, embedder: Embedder | None, out: str = "embedding") -> DataFrame:
    """Add ``out``, the vectors of column ``text``, with the given embedder."""
    if embedder is None:
        raise ValueError("an embedder is required")
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType(), False), True)])
    position = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = embedder(batch.column(position).to_pylist())
            rows = [None if v is None else np.asarray(v, dtype=np.float32) for v in vectors]
            column = pa.array(rows, type=pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def embed_hashed(df: DataFrame, text: str, width: int = 256, out: str = "embedding") -> DataFrame:
    """The built-in embedder: hashed word counts scaled to length 1.

    Runs in the JVM with Spark ML transformers and needs no model.
    """
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\W+", toLowercase=True)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=width)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    staged = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    staged = unit.transform(counts.transform(words.transform(staged)))
    return staged.withColumn(out, vector_to_array("_unit", "float32")).drop("_text", "_words", "_counts", "_unit")
