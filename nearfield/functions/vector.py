"""Vector functions as Column expressions; sums are in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; different lengths are an error, as zip_with would fill up with nulls."""
    same = F.size(a) == F.size(b)
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.when(same, F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    below = norm(a) * norm(b)
    return F.when(below == 0, F.lit(0.0)).otherwise(dot(a, b) / below)


def normalize(a: Column) -> Column:
    """Unit length; a vector of zeros stays."""
    length = norm(a)
    return F.when(length == 0, _doubles(a)).otherwise(F.transform(_doubles(a), lambda x: x * (F.lit(1.0) / length)))


def quantize(a: Column) -> Column:
    """int8 codes: floor(127 x + 0.5) within -127 and 127. Rounding is half up; NaN becomes 0."""
    code = lambda x: F.least(F.lit(127), F.greatest(F.lit(-127), F.floor(F.when(F.isnan(x), F.lit(0.0)).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(-2.0), x))) * 127 + 0.5)))
    return F.transform(_doubles(a), lambda x: code(x).cast("tinyint"))


def dequantize(codes: Column) -> Column:
    return F.transform(codes, lambda q: (q.cast("double") / 127).cast("float"))
