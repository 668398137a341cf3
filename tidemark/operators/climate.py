"""Climate: standard columns, unions with precedence, roll-ups, summaries and comparisons."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import is_weekend
from ..functions.numeric import half_up, ratio
from ..schema import CLIMATE
from .clean import keep_first
from .features import CLIMATE_MEASURES
from .fill import linear_fill

# Provider column that stands in for a standard one.
ALIASES = {
    "temperature": "temperature_2m",
    "humidity": "relativehumidity_2m",
    "pressure": "pressure_msl",
    "wind_speed": "windspeed_10m",
    "cloud_cover": "cloudcover",
}

# Region -> cities, and the zone of all of them.
REGIONS = {"广东": ["广州", "深圳", "东莞", "佛山", "中山", "珠海", "惠州", "江门", "肇庆", "汕头"]}
DEFAULT_TIMEZONE = "Asia/Shanghai"


def region_cities(spark: SparkSession, regions: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The configured regions as a ``region, city, timezone`` table."""
    rows = [(r, c, DEFAULT_TIMEZONE) for r, cities in (regions or REGIONS).items() for c in cities]
    return spark.createDataFrame(rows, "region string, city string, timezone string")


def standardise(df: DataFrame, provider: str) -> DataFrame:
    """The eleven standard columns; a missing one comes from its alias or is null."""
    columns = []
    for field in CLIMATE:
        name = field.name
        if name == "data_source":
            col = F.lit(provider)
        elif name in df.columns:
            col = F.col(name)
        elif ALIASES.get(name) in df.columns:
            col = F.col(ALIASES[name])
        else:
            col = F.lit(None)
        columns.append(col.cast(field.dataType).alias(name))
    return df.select(columns)


def split_horizon(days: int, max_history: int = 3) -> tuple[int, int]:
    """How many days of a request are history and how many are forecast."""
    history = min(max_history, days)
    return history, max(1, days - history)


def horizon(history: DataFrame, forecast: DataFrame, as_of: dt.date, days: int, max_history: int = 3) -> DataFrame:
    """The last days of history up to ``as_of`` and the days of forecast after it; history wins."""
    back, ahead = split_horizon(days, max_history)
    now = F.lit(as_of)
    past = history.filter((F.col("date") > F.date_sub(now, back)) & (F.col("date") <= now))
    coming = forecast.filter((F.col("date") > now) & (F.col("date") <= F.date_add(now, ahead)))
    return union_preferring(past, coming)


def union_preferring(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("city", "date")) -> DataFrame:
    """Rows of both, one per key; where both have one, the first relation's."""
    both = first.withColumn("_prio", F.lit(0)).unionByName(
        second.withColumn("_prio", F.lit(1)), allowMissingColumns=True
    )
    return keep_first(both, list(keys), "_prio").drop("_prio")


def fail_over(primary: DataFrame, secondary: DataFrame, measures: Sequence[str],
              keys: Sequence[str] = ("city", "date")) -> DataFrame:
    """Primary readings, taken from the secondary row where the primary has no row.

    Both sides are first reduced to one row per key; the join then needs no further shuffle.
    """
    a = keep_first(primary.select(*keys, *measures), keys).withColumn("_primary", F.lit(True))
    b = keep_first(secondary.select(*keys, *measures), keys).select(
        *keys, *[F.col(m).alias(f"_b_{m}") for m in measures]
    )
    won = F.coalesce("_primary", F.lit(False))
    return a.join(b, list(keys), "full_outer").select(
        *keys, *[F.when(won, F.col(m)).otherwise(F.col(f"_b_{m}")).alias(m) for m in measures],
        F.when(won, "primary").otherwise("secondary").alias("data_source"),
    )


def compare_sources(a: DataFrame, b: DataFrame, measures: Sequence[str] = ("temperature", "humidity", "pressure"),
                    keys: Sequence[str] = ("city", "date")) -> DataFrame:
    """Both providers' values and their difference, for each key that either has."""
    left = keep_first(a.select(*keys, *measures), keys)
    right = keep_first(b.select(*keys, *measures), keys)
    left = left.select(*keys, *[F.col(m).alias(f"{m}_a") for m in measures])
    right = right.select(*keys, *[F.col(m).alias(f"{m}_b") for m in measures])
    diffs = [(F.col(f"{m}_a") - F.col(f"{m}_b")).alias(f"{m}_diff") for m in measures]
    return left.join(right, list(keys), "full_outer").select("*", *diffs)


def overlap_days(a: DataFrame, b: DataFrame, columns: Sequence[str] = ("date",)) -> DataFrame:
    """Days that both relations hold."""
    return a.select(*columns).distinct().intersect(b.select(*columns).distinct())


def enrich(main: DataFrame, climate: DataFrame, key: Sequence[str] = ("region",), date: str = "date") -> DataFrame:
    """Climate beside each main row, its gaps filled within the region.

    Filling stays within a region: one region's climate says nothing about the next one's. The region's days are filled
    first, one row for each day that has a main row, so any number of main rows of a day take the same values and no
    task gets more rows of a region than the calendar has days.
    """
    measures = [c for c in CLIMATE_MEASURES if c in climate.columns]
    days = main.select(*key, date).distinct().join(climate.select(*key, date, *measures), [*key, date], "left")
    return main.join(linear_fill(days, key, measures, date, ties=measures), [*key, date], "left")


def by_region(climate: DataFrame, cities: DataFrame) -> DataFrame:
    """City climate per region and day: means over the cities, and the sum of precipitation.

    Reduced to one row per city and day before the join with the city table.
    """
    means = [c for c in CLIMATE_MEASURES if c != "precipitation"]
    daily = climate.groupBy("city", "date").agg(
        *[F.avg(c).alias(c) for c in means], F.sum("precipitation").alias("precipitation")
    )
    return daily.join(cities.select("city", "region"), "city").groupBy("region", "date").agg(
        *[F.avg(c).alias(c) for c in means], F.sum("precipitation").alias("precipitation")
    )


def daily_forecast(readings: DataFrame) -> DataFrame:
    """3-hourly readings per city and day, with a confidence from the day's temperature range.

    The readings are first reduced per city, day, climate type and source, which needs sums
    and extremes of numbers only and so runs as a hash aggregate over the readings. The most
    frequent type and the source are then taken from those few rows per city and day.
    """
    means = ["temperature", "humidity", "pressure", "wind_speed"]
    parts = readings.groupBy("city", "date", "weather_main", "data_source").agg(
        F.count("*").alias("_n"), F.min("temperature").alias("temp_min"), F.max("temperature").alias("temp_max"),
        F.sum("precipitation").alias("precipitation"),
        *[x for c in means for x in (F.sum(c).alias(f"_sum_{c}"), F.count(c).alias(f"_n_{c}"))],
    )
    by_type = parts.groupBy("city", "date", "weather_main").agg(
        F.sum("_n").alias("_n"), F.min("temp_min").alias("temp_min"), F.max("temp_max").alias("temp_max"),
        F.sum("precipitation").alias("precipitation"),
        F.min("data_source").alias("_source_low"), F.max("data_source").alias("_source_high"),
        *[F.sum(f"{p}_{c}").alias(f"{p}_{c}") for c in means for p in ("_sum", "_n")],
    )
    # no type is no candidate for the most frequent one
    votes = F.when(F.col("weather_main").isNotNull(), F.struct(-F.col("_n"), F.col("weather_main")))
    span = F.abs(F.col("temp_max") - F.col("temp_min"))
    return by_type.groupBy("city", "date").agg(
        *[ratio(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")).alias(c) for c in means],
        F.min("temp_min").alias("temp_min"), F.max("temp_max").alias("temp_max"),
        F.sum("precipitation").alias("precipitation"), F.min_by("weather_main", votes).alias("weather_main"),
        F.when(F.min("_source_low") == F.max("_source_high"), F.min("_source_low")).otherwise("mixed")
        .alias("data_source"),
    ).withColumn("is_weekend", is_weekend(F.col("date"))).withColumn(
        "temp_confidence", F.least(F.lit(95.0), F.greatest(F.lit(70.0), 100 - span * 5))
    )


def climate_summary(climate: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
                    key: Sequence[str] = ("city",)) -> DataFrame:
    """Per city and period; completeness is 1 minus the null share of the worst column."""
    rows = climate
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end))
    nulls = [F.count_if(F.col(c).isNull()) for c in climate.columns if c not in key]
    t, h, p = F.col("temperature"), F.col("humidity"), F.col("precipitation")
    return rows.groupBy(*key).agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("total_days"),
        F.avg(t).alias("temperature_mean"), F.min(t).alias("temperature_min"), F.max(t).alias("temperature_max"),
        F.stddev_samp(t).alias("temperature_std"),
        F.avg(h).alias("humidity_mean"), F.min(h).alias("humidity_min"), F.max(h).alias("humidity_max"),
        F.sum(p).alias("precipitation_total"), F.max(p).alias("precipitation_max"),
        F.count_if(p > 0).alias("rainy_days"),
        (1 - F.greatest(*nulls) / F.count("*")).alias("data_completeness"),
    )


def city_summary(climate: DataFrame, key: Sequence[str] = ("city",)) -> DataFrame:
    """Per city to one digit, with climate types counted and the share of filled cells."""
    cells = len(climate.columns)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in climate.columns), F.lit(0))

    def tenth(col: Column) -> Column:
        return half_up(col, 1)

    stats = []
    for c in ("temperature", "humidity", "pressure"):
        stats += [tenth(F.avg(c)).alias(f"{c}_mean"), tenth(F.max(c)).alias(f"{c}_max"),
                  tenth(F.min(c)).alias(f"{c}_min")]
    base = climate.groupBy(*key).agg(
        F.count("*").alias("total_days"), *stats, tenth(F.stddev_samp("temperature")).alias("temperature_std"),
        tenth(F.avg("wind_speed")).alias("wind_speed_mean"), tenth(F.max("wind_speed")).alias("wind_speed_max"),
        tenth(F.sum("precipitation")).alias("precipitation_total"),
        F.count_if(F.col("precipitation") > 0).alias("precipitation_days"),
        F.count_if("is_holiday").alias("holidays"), F.count_if("is_weekend").alias("weekends"),
        (100 - F.floor(nulls / (F.count("*") * cells) * 100)).alias("data_quality"),
    )
    return base.join(condition_types(climate, key), list(key), "left")


def condition_types(climate: DataFrame, key: Sequence[str] = ("city",)) -> DataFrame:
    """How often each climate type occurs, as a map; counted per type before types are gathered."""
    counted = climate.filter(F.col("weather_main").isNotNull()).groupBy(*key, "weather_main").agg(
        F.count("*").alias("n")
    )
    entries = F.array_sort(F.collect_list(F.struct("weather_main", "n")))
    return counted.groupBy(*key).agg(F.map_from_entries(entries).alias("weather_types"))


def mean_and_max(climate: DataFrame, measure: str = "max_temperature", key: Sequence[str] = ("city",)) -> DataFrame:
    return climate.groupBy(*key).agg(
        F.avg(measure).alias(f"mean_{measure}"), F.max(measure).alias(f"max_{measure}")
    )
