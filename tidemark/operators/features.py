"""Lag, rolling, trend, sequence and climate features of daily series.

Columns are always emitted: a series shorter than a lag or window has nulls there, so the
schema does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, cyclic_columns
from .fill import carry_then_zero, on_daily_spine

MODEL_LAGS = (1, 2, 3, 7, 14, 30)
MODEL_WINDOWS = (3, 7, 14, 30)
CLIMATE_MEASURES = ("temperature", "humidity", "pressure", "wind_speed", "precipitation")

_ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def add_lags(df: DataFrame, key: Sequence[str], value: str, lags: Sequence[int], date: str = "date") -> DataFrame:
    w = W.partitionBy(*key).orderBy(date)
    return df.withColumns({f"lag_{n}": F.lag(value, n).over(w) for n in lags})


def add_rolling(
    df: DataFrame, key: Sequence[str], value: str, windows: Sequence[int], stats: Sequence[str], date: str = "date",
) -> DataFrame:
    """Rolling statistics over the last n rows, null until n values are there."""
    columns = {}
    for n in windows:
        frame = W.partitionBy(*key).orderBy(date).rowsBetween(1 - n, 0)
        full = F.count(value).over(frame) == n
        for stat in stats:
            columns[f"rolling_{stat}_{n}"] = F.when(full, _ROLLING[stat](value).over(frame))
    return df.withColumns(columns)


def add_trend(df: DataFrame, key: Sequence[str], date: str = "date") -> DataFrame:
    pos = F.row_number().over(W.partitionBy(*key).orderBy(date)) - 1
    return df.withColumn("trend", pos).withColumn(
        "trend_squared", F.col("trend").cast("bigint") * F.col("trend")
    )


def sequence_windows(
    df: DataFrame, key: Sequence[str], value: str = "value", look_back: int = 7, date: str = "date",
) -> DataFrame:
    """The ``look_back`` values before each row as an array, with the row's value as target."""
    before = W.partitionBy(*key).orderBy(date).rowsBetween(-look_back, -1)
    rank = F.row_number().over(W.partitionBy(*key).orderBy(date))
    return (
        df.withColumn("_rank", rank).withColumn("inputs", F.collect_list(value).over(before))
        .filter(F.col("_rank") > look_back)
        .select(*key, date, "inputs", F.col(value).alias("target"))
    )


def flag_dates(df: DataFrame, calendar: DataFrame, flag: str = "is_holiday", date: str = "date") -> DataFrame:
    """1 on the dates the calendar holds, else 0.

    A calendar of usual size is broadcast, as Spark sees its size; a larger one is joined by date, and AQE splits the
    days that hold very many rows.
    """
    marked = calendar.select(F.col(date)).distinct().withColumn("_on", F.lit(1))
    return df.join(marked, date, "left").withColumn(flag, F.coalesce("_on", F.lit(0))).drop("_on")


def resample_climate(df: DataFrame, key: Sequence[str], date: str = "date") -> DataFrame:
    """One row per key and day: means, and the sum of precipitation (0 on days without rows)."""
    daily = df.groupBy(*key, date).agg(
        *[F.avg(c).alias(c) for c in CLIMATE_MEASURES if c != "precipitation"],
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
    )
    spread = on_daily_spine(daily, key, date)
    return spread.withColumn("precipitation", F.coalesce("precipitation", F.lit(0.0)))


def align_climate(df: DataFrame, climate: DataFrame, key: Sequence[str], date: str = "date") -> DataFrame:
    """``climate_*`` columns on the rows of ``df``: the daily resample, carried forward, then back.

    All or nothing: a climate relation that lacks a measure adds no column.
    """
    if any(c not in climate.columns for c in CLIMATE_MEASURES):
        return df
    daily = resample_climate(climate, key, date).select(
        *key, date, *[F.col(c).alias(f"weather_{c}") for c in CLIMATE_MEASURES]  # fixed values: names of the features
    )
    joined = df.join(daily, [*key, date], "left")
    names = [f"weather_{c}" for c in CLIMATE_MEASURES]
    back = W.partitionBy(*key).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*key).orderBy(F.col(date).desc()).rowsBetween(W.unboundedPreceding, 0)
    carried = joined.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in names})
    return carried.withColumns({c: F.last(c, ignorenulls=True).over(ahead) for c in names})


def feature_table(
    df: DataFrame, key: Sequence[str], value: str = "value", climate: DataFrame | None = None,
    holidays: DataFrame | None = None, lags: bool = True, rolling: bool = True, dates: bool = True,
    date: str = "date",
) -> DataFrame:
    """Calendar, lag, rolling, climate and trend features, without nulls.

    Joins come first and windows last, so that all windows share one shuffle by key.
    """
    out = df.select(*key, date, value)
    if dates:
        if holidays is not None:
            out = flag_dates(out, holidays, date=date)
        else:
            out = out.withColumn("is_holiday", F.lit(0))
    if climate is not None:
        out = align_climate(out, climate, key, date)
    if dates:
        out = out.withColumns(calendar_columns(F.col(date))).withColumns(cyclic_columns(F.col(date)))
    if lags:
        out = add_lags(out, key, value, MODEL_LAGS, date)
    if rolling:
        out = add_rolling(out, key, value, MODEL_WINDOWS, ("mean", "std", "min", "max"), date)
    out = add_trend(out, key, date)
    names = feature_names(out, key, value, date)
    return carry_then_zero(out, key, names, date)


def feature_names(df: DataFrame, key: Sequence[str], value: str = "value", date: str = "date") -> list[str]:
    return [c for c in df.columns if c not in (*key, value, date)]
