"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k out of n; exactly 0 and 1 at the edges, null for n = 0."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, d = k / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    low = F.when(k == 0, 0.0).otherwise(F.greatest(middle - half, F.lit(0.0)))
    high = F.when(k == n, 1.0).otherwise(F.least(middle + half, F.lit(1.0)))
    return F.when(n.isNotNull(), low), F.when(n.isNotNull(), high)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of counts; null where it isn't defined."""
    return 2 * tp / F.nullif((2 * tp + fp + fn).cast("double"), F.lit(0.0))


def ramp(x: Column, full: float, zero: float) -> Column:
    """1 up to ``full``, 0 from ``zero`` on, linear between; null stays null."""
    return F.when(x <= full, 1.0).when(x >= zero, 0.0).when(x.isNotNull(), (zero - x) / (zero - full))


def truncate(x: Column, decimals: int) -> Column:
    """Cut, not rounded, to so many decimals."""
    return F.floor(x * 10.0**decimals) / 10.0**decimals


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector divided by its length; a vector of zeros stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / length))
