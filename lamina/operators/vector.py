"""Vector expressions and exact top-k search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f16(x: Column) -> Column:
    """A number rounded to half precision, as a double."""
    v = x.cast("double")
    exponent = F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14)) - 10
    unit = F.pow(F.lit(2.0), exponent)
    return F.when(v == 0, v).otherwise(F.rint(v / unit) * unit)


def f16_vector(v: Column) -> Column:
    return F.transform(v, f16)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null for a zero vector."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(rows: DataFrame, vector: str, query: Column, limit: int, ties: list[str]) -> DataFrame:
    """The limit rows of least cosine distance with score = 1 - distance; nulls last, ties by the given columns."""
    d = rows.withColumn("_d", cosine_distance(F.col(vector), query))
    return d.orderBy(F.col("_d").asc_nulls_last(), *ties).limit(limit).withColumn("score", 1 - F.col("_d")).drop("_d")
