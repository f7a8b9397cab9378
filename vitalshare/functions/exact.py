"""Sums of doubles that do not depend on the order of their rows, on built-in functions.

A value is cut into whole 2^-20 steps and the 2^-50 steps left over, both as long integers. Sums
of integers are exact, so any partitioning, any order and any number of partial sums give the
same bits. What lies below 2^-50 is cut off before adding, value by value. A group's total may
reach 2^43 and its rows 2^33; beyond that the integers overflow, which Spark reports as an error.
NULL is skipped as by ``sum``.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

_COARSE, _FINE = 20, 30


def _coarse(x: Column) -> Column:
    return F.floor(x * F.lit(float(1 << _COARSE)))


def _fine(x: Column) -> Column:
    scaled = x * F.lit(float(1 << _COARSE))
    return ((scaled - F.floor(scaled).cast("double")) * F.lit(float(1 << _FINE))).cast("long")


def parts(x: Column) -> tuple[Column, Column]:
    """The two integers of a value."""
    return _coarse(x), _fine(x)


def value(coarse: Column, fine: Column) -> Column:
    """The double that two sums of such integers stand for."""
    step = 2.0**-_COARSE
    return coarse.cast("double") * F.lit(step) + fine.cast("double") * F.lit(step * 2.0**-_FINE)


def exact_sum(c, over: WindowSpec | None = None) -> Column:
    """``sum`` of a double column, as an aggregate or over a window without order."""
    sums = [F.sum(x) for x in parts(F.col(c) if isinstance(c, str) else c)]
    return value(*(x.over(over) if over is not None else x for x in sums))
