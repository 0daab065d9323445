"""Column expressions for the library's rules on missing values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL when ``b`` is 0, where plain division fails in ANSI mode."""
    return F.try_divide(a, b)


def full_window(value: Column, seen: Column, size: int) -> Column:
    """``value`` only where all ``size`` rows of the frame were present."""
    return F.when(seen == size, value)


def double_array(values: Iterable[float]) -> Column:
    """A constant array passed to the plan as one literal.

    ``array(lit, lit, ...)`` makes one expression per element, which is slow to
    plan for thousands of fitted parameters.
    """
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def total(array: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def elements(array: str, position: str = "f", value: str = "x") -> Column:
    """One row per element of a never-empty array.

    The outer variant, because for the plain one Spark adds a filter on the array's size, which
    computes the array a second time.
    """
    return F.posexplode_outer(array).alias(position, value)
