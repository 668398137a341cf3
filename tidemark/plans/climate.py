"""Climate for many cities: landed payloads to one repaired standard table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import is_weekend
from ..operators import features, fill, climate

_NUMBERS = ("temperature", "humidity", "pressure", "wind_speed", "precipitation")


def standard_daily(readings: DataFrame, provider: str, holidays: DataFrame | None = None) -> DataFrame:
    """Readings per city and day in the standard columns."""
    daily = climate.daily_forecast(readings)
    if holidays is None:
        daily = daily.withColumn("is_holiday", F.lit(False))
    else:
        daily = features.flag_dates(daily, holidays).withColumn("is_holiday", F.col("is_holiday") == 1)
    return climate.standardise(daily, provider)


def complete(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast, one row per city and day, numbers interpolated within each city."""
    both = climate.union_preferring(history, forecast)
    filled = fill.repair_observations(both, ["city"], _NUMBERS, ["cloud_cover", "is_holiday", "data_source"])
    return filled.withColumn("is_weekend", is_weekend(F.col("date")))
