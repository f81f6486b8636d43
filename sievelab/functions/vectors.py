"""Expressions on dense array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F


def array_sum(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(array_sum(F.transform(v, lambda x: x * x)))


def scale_by(v: Column | str, divisor: Column) -> Column:
    """Each element over ``divisor``, which is evaluated once per row and not once per element."""
    return F.zip_with(v, F.array_repeat(divisor, F.size(v)), lambda x, d: x / d)


def l2_normalize(v: Column | str) -> Column:
    """Unit row; a zero row stays zero."""
    length = norm(v)
    return scale_by(v, F.when(length > 0, length).otherwise(F.lit(1.0)))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def class_means(df: DataFrame, features: str = "features", label: str = "sentiment") -> dict[int, list[float]]:
    """Mean vector of each class. Only classes x dimensions numbers reach the driver."""
    mean = Summarizer.mean(array_to_vector(features)).alias("m")
    return {r[label]: r["m"].toArray().tolist() for r in df.groupBy(label).agg(mean).orderBy(label).collect()}


def distances_to(means: Sequence[Sequence[float]], features: str = "features") -> Column:
    """Array of the distances from a row to each of a few fixed points."""
    return F.array(*[F.sqrt(squared_distance(features, F.lit(list(m)))) for m in means])
