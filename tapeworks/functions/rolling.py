"""Column functions over the last bars of a series. All look back only, and are null until their window is full."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tapeworks.sources.bars import SERIES


def series() -> WindowSpec:
    return Window.partitionBy(*SERIES).orderBy("i")


def last(n: int, skip: int = 0) -> WindowSpec:
    """The last ``n`` bars, without the newest ``skip``."""
    return series().rowsBetween(1 - n - skip, -skip)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, x: Column, n: int, skip: int = 0) -> Column:
    """``value`` where the window holds ``n`` values of ``x``."""
    return F.when(F.count(x).over(last(n, skip)) >= n, value)


def mean(x: Column, n: int, skip: int = 0) -> Column:
    return full(F.avg(x).over(last(n, skip)), x, n, skip)


def total(x: Column, n: int) -> Column:
    return full(F.sum(x).over(last(n)), x, n)


def highest(x: Column, n: int) -> Column:
    return full(F.max(x).over(last(n)), x, n)


def lowest(x: Column, n: int) -> Column:
    return full(F.min(x).over(last(n)), x, n)


def deviation(x: Column, n: int) -> Column:
    return full(F.stddev_pop(x).over(last(n)), x, n)


def before(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(series())


def over(x: Column, y: Column) -> Column:
    """``x / y``; null where y is 0."""
    return x / F.nullif(y, F.lit(0.0))
