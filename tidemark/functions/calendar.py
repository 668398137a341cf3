"""Calendar columns of a date."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_weekend(date: Column) -> Column:
    return F.weekday(date) >= 5


def calendar_columns(date: Column) -> dict[str, Column]:
    """Day, month, quarter and weekend flag; Monday is day 0."""
    return {
        "day_of_week": F.weekday(date),
        "day_of_month": F.dayofmonth(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "is_weekend": is_weekend(date).cast("int"),
    }


def date_part_columns(date: Column) -> dict[str, Column]:
    """The date parts a forecaster is given."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "dayofweek": F.weekday(date),
        "dayofyear": F.dayofyear(date),
        "quarter": F.quarter(date),
    }


def cyclic_columns(date: Column) -> dict[str, Column]:
    """Position in the year and in the week as points on a circle."""
    year = F.dayofyear(date) * (2 * math.pi / 365.25)
    week = F.weekday(date) * (2 * math.pi / 7)
    return {
        "day_sin": F.sin(year), "day_cos": F.cos(year),
        "week_sin": F.sin(week), "week_cos": F.cos(week),
    }


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(date)))


def with_date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(date_part_columns(F.col(date)))


def with_cycles(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(cyclic_columns(F.col(date)))
