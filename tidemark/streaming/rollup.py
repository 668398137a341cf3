"""Daily roll-up of readings on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import utc_day, utc_instant

MEANS = ("temperature", "humidity", "pressure", "wind_speed")


def daily_rollup(readings: DataFrame, ts: str = "ts", lateness: str = "3 hours") -> DataFrame:
    """One row per city and UTC day, emitted once the watermark has passed the day.

    Readings are first rolled up by city, day and climate type, whatever types there are, then by city and day, so the
    state of a day has a row for each type that occurs. The most frequent type wins, of equal ones the smaller name.
    Readings later than ``lateness`` are left out; ``run.run_counted`` tells how many.
    """
    timed = readings.withColumn(ts, utc_instant(readings, ts)).withWatermark(ts, lateness)
    sums = [x for c in MEANS for x in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))]
    kinds = timed.groupBy("city", "weather_main", F.window(ts, "1 day").alias("_day")).agg(
        *sums, F.min("temperature").alias("_least"), F.max("temperature").alias("_most"),
        F.sum("precipitation").alias("_rain"), F.count("*").alias("_n"),
        F.min("data_source").alias("_source"), F.max("data_source").alias("_other_source"),
    )
    kind = F.when(F.col("weather_main").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("weather_main").alias("kind")))
    daily = kinds.groupBy("city", F.window(F.window_time("_day"), "1 day").alias("_window")).agg(
        *[(F.sum(f"_s_{c}") / F.nullif(F.sum(f"_n_{c}"), F.lit(0))).alias(c) for c in MEANS],
        F.min("_least").alias("temp_min"), F.max("_most").alias("temp_max"), F.sum("_rain").alias("precipitation"),
        F.sum("_n").alias("n_readings"), F.min(kind)["kind"].alias("weather_main"),
        F.when(F.min("_source") != F.max("_other_source"), "mixed").otherwise(F.min("_source")).alias("data_source"),
    )
    span = F.abs(F.col("temp_max") - F.col("temp_min"))
    date = utc_day(F.col("_window.start"))
    return daily.select(
        "city", date.alias("date"), "temperature", "temp_min", "temp_max", "humidity", "pressure", "wind_speed",
        "precipitation", "n_readings", "weather_main", "data_source", (F.weekday(date) >= 5).alias("is_weekend"),
        F.least(F.lit(95.0), F.greatest(F.lit(70.0), 100 - span * 5)).alias("temp_confidence"),
    )
