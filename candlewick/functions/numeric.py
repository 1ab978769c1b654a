"""Column functions with the engine's own rounding, median and quantile rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settle(x: Column, scale: float = 1e6) -> Column:
    """Rounds to 1/scale, halves up, on the binary product; -0.0 becomes 0.0.

    Spark's floor of a double is a 64-bit integer, 0 for NaN and cut at 2^63, so the floor is made from rint, which
    stays a double: NaN, infinities and values of any size keep what they are.
    """
    raised = x * scale + 0.5
    whole = F.rint(raised)
    return (whole - F.when(whole > raised, 1.0).otherwise(0.0)) / scale


def round_half_away(x: Column, digits: int) -> Column:
    """Rounds half away from zero on the binary product: the grid of prices."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + F.lit(0.0)


def finite(x: Column) -> Column:
    """NULL for NaN and infinities: undefined is NULL everywhere."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def divide(a: Column, b: Column) -> Column:
    """a / b; NULL where b is zero or NULL."""
    return a / F.when(b != 0, b)


def upper_median(name: str) -> Column:
    """Aggregate over a column name: the middle value, the upper of two; NULLs do not count.

    Of values in falling order, the first with at least half of all at or before it; counted by distinct values,
    partially before the shuffle.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def nearest_rank(values: Column, p: float) -> Column:
    """Of a sorted array: the element at round(p * (n - 1)), halves away from zero; NULL of an empty one."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, (F.floor(F.lit(p) * (n - 1) + 0.5) + 1).cast("int")))

