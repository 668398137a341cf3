"""Numeric expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(col: Column, low: float, high: float) -> Column:
    """Hold a number within bounds; null stays null."""
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), col))
    return F.when(col.isNotNull(), bounded)


def ratio(num: Column, den: Column) -> Column:
    """The quotient, null where the denominator is zero."""
    return F.try_divide(num, den)


def half_up(col: Column, digits: int) -> Column:
    """Rounded half up; noise in the last digits of a double does not decide a half."""
    return F.round(F.round(col, 8), digits)


def percent_of(part: Column, whole: Column) -> Column:
    return half_up(ratio(part, whole) * 100, 2)


def normal_quantile(confidence: float) -> float:
    """Half-width of a two-sided normal interval, in standard deviations."""
    return NormalDist().inv_cdf((1 + confidence) / 2)
