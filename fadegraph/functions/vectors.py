"""Vector arithmetic as column expressions.

These run inside the JVM and serve joins that already pair one vector with
another.  Comparing many vectors with many is ``operators.similarity``.
Vectors are arrays of float or double; sums are taken in double.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def _clamped_ratio(product: Column, scale: Column) -> Column:
    # The ratio is bound to a name so that it is worked out once; greatest and
    # least alone would turn its NULL into a number.
    ratio = F.transform(F.array(F.try_divide(product, scale)), lambda r: F.when(
        r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))
    return F.get(ratio, F.lit(0))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle, kept in [-1, 1]; NULL when a vector has no length.

    NULL rather than NaN, because Spark orders NaN above every number and a
    ``similarity > t`` filter would let it pass.
    """
    return _clamped_ratio(dot(a, b), norm(a) * norm(b))


def cosine_of_normed(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """``cosine_similarity`` with norms worked out before the vectors were paired."""
    return cosine_of_dot(dot(a, b), norm_a, norm_b)


def cosine_of_dot(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """``cosine_similarity`` from the product of the vectors and their norms."""
    return _clamped_ratio(product, norm_a * norm_b)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def cosine_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(cosine_similarity(a, b), F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    def squared(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.sqrt(_total(F.zip_with(a, b, squared)))


def relevance(topic_vector: Column, content_vector: Column) -> Column:
    """1 for equal vectors, falling with half the distance, never below 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - l2_distance(topic_vector, content_vector) / 2)


def group_mean(df: DataFrame, keys: list[str], vector: str, out: str = "mean_vector") -> DataFrame:
    """Mean vector per group; partial sums are formed before the shuffle."""
    as_vector = array_to_vector(F.col(vector).cast("array<double>"))
    means = df.groupBy(*keys).agg(Summarizer.mean(as_vector).alias("_mean"))
    return means.select(*keys, vector_to_array("_mean").alias(out))
