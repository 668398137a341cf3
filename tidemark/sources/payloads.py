"""Landed provider payloads: JSON documents, one per file row, turned into rows.

A document that is not of the expected shape goes to a reject table and does not stop the
other documents or cities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import is_weekend
from ..operators.features import flag_dates
from ..operators.climate import DEFAULT_TIMEZONE
from ..schema import DAILY_PAYLOAD, GEOCODE_PAYLOAD, READINGS_PAYLOAD, finite


def read_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``city, payload``: the landed folder is partitioned by city; a row is a document."""
    return spark.read.schema("payload string, city string").option("wholetext", whole_files).format("text").load(path)


def parse_daily(payloads: DataFrame, data_type: str = "historical") -> tuple[DataFrame, DataFrame]:
    """Rows of documents with parallel daily arrays, and the rejected documents."""
    parsed = payloads.withColumn("_doc", F.from_json("payload", DAILY_PAYLOAD))
    good = F.coalesce(F.col("_doc.daily.time").isNotNull(), F.lit(False))
    daily, nothing = F.col("_doc.daily"), F.array().cast("array<double>")
    # a measure that was not asked for has no array, and zipping a null array gives no rows
    zipped = F.arrays_zip(daily["time"].alias("time"), *[
        F.coalesce(daily[source], nothing).alias(name) for source, name in (
            ("temperature_2m_max", "max"), ("temperature_2m_min", "min"), ("precipitation_sum", "precipitation"),
        )
    ])
    rows = parsed.filter(good).select("city", F.explode(zipped).alias("_r")).select(
        "city", F.col("_r").getField("time").try_cast("date").alias("date"),
        finite(F.col("_r").getField("max")).alias("max_temperature"),
        finite(F.col("_r").getField("min")).alias("min_temperature"),
        finite(F.col("_r").getField("precipitation")).alias("precipitation"),
        F.lit(data_type).alias("data_type"),
    )
    rejects = parsed.filter(~good).select("city", "payload", F.lit("no daily block").alias("error"))
    return rows, rejects


def parse_readings(
    payloads: DataFrame, source: str = "api", zones: DataFrame | None = None, holidays: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of documents with a list of nested readings, and the rejected documents.

    No rain entry means 0; the first of several entries of conditions counts. Dates are those of the city's zone, from
    ``zones`` (city, timezone; a city it lacks is in UTC). Holidays are the dates that ``holidays`` holds.
    """
    parsed = payloads.withColumn("_doc", F.from_json("payload", READINGS_PAYLOAD))
    good = F.coalesce(F.col("_doc.list").isNotNull(), F.lit(False))
    item = parsed.filter(good).select("city", F.explode("_doc.list").alias("_i"))
    ts = F.timestamp_seconds("_i.dt")
    zone = F.lit("UTC")
    if zones is not None:
        item = item.join(zones.select("city", F.col("timezone").alias("_zone")), "city", "left")
        zone = F.coalesce("_zone", zone)
    # from the instant in UTC, whatever the session's zone is
    wall_clock = F.convert_timezone(F.lit("UTC"), zone, F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")))
    day = F.to_date(wall_clock)
    first = F.try_element_at("_i.weather", F.lit(1))
    rows = item.select(
        "city", ts.alias("ts"), day.alias("date"),
        finite(F.col("_i.main.temp")).alias("temperature"), finite(F.col("_i.main.humidity")).alias("humidity"),
        finite(F.col("_i.main.pressure")).alias("pressure"), finite(F.col("_i.wind.speed")).alias("wind_speed"),
        F.coalesce(finite(F.col("_i.rain").getField("3h")), F.lit(0.0)).alias("precipitation"),
        first.getField("main").alias("weather_main"), first.getField("description").alias("weather_description"),
        is_weekend(day).alias("is_weekend"), F.lit(source).alias("data_source"),
    )
    if holidays is None:
        rows = rows.withColumn("is_holiday", F.lit(False))
    else:
        rows = flag_dates(rows, holidays).withColumn("is_holiday", F.col("is_holiday") == 1)
    rejects = parsed.filter(~good).select("city", "payload", F.lit("no list block").alias("error"))
    return rows, rejects


def parse_city_hits(payloads: DataFrame) -> DataFrame:
    """``city, name, lat, lon, timezone`` from the first hit of each search; no hit gives nulls."""
    hit = F.try_element_at(F.col("_doc.results"), F.lit(1))
    return payloads.withColumn("_doc", F.from_json("payload", GEOCODE_PAYLOAD)).withColumn("_hit", hit).select(
        "city",
        F.when(F.col("_hit").isNotNull(), F.coalesce("_hit.name", "city")).alias("name"),
        F.col("_hit.latitude").alias("lat"), F.col("_hit.longitude").alias("lon"),
        F.when(F.col("_hit").isNotNull(), F.coalesce("_hit.timezone", F.lit(DEFAULT_TIMEZONE))).alias("timezone"),
    )
