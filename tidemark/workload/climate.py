"""Climate: vocabulary, payloads, unions, roll-ups, summaries, comparisons, enrichment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import climate as rules
from ..operators import features, climate
from ..plans import climate as plans
from ..schema import utc_instant
from ..sources import payloads, snapshots
from ..storage import fresh_path
from .inputs import (
    city_regions, ctes, event_regions, holiday_dates, readings, climate_daily, climate_full,
)
from .registry import half_up, query, rounded, sql_with
from .series import interpolate_sql

MEASURES = list(features.CLIMATE_MEASURES)


def _measures_sql(columns=MEASURES, digits: int = 4) -> str:
    return ", ".join(f"{half_up(c, digits)} AS {c}" for c in columns)


@query("climate_vocabulary", "P9 P10 P11", sql_with(ctes("readings"), body="""
    SELECT event_id, CASE WHEN precipitation = 0 THEN 'dry' WHEN precipitation > 5 THEN 'wet' ELSE 'mixed' END AS icon,
           CASE weather_main WHEN 'Clear' THEN '晴天' WHEN 'Clouds' THEN '多云' WHEN 'Rain' THEN '雨天'
                WHEN 'Snow' THEN '雪天' WHEN 'Drizzle' THEN '小雨' ELSE weather_main END AS description,
           CASE WHEN precipitation > 5 THEN CASE WHEN temperature > 0 THEN 'Rain' ELSE 'Snow' END
                WHEN humidity > 80 AND pressure < 1010 THEN 'Clouds'
                WHEN humidity < 40 AND pressure > 1020 THEN 'Clear' END AS by_rule
    FROM readings"""))
def climate_vocabulary(spark, sf_dir):
    rule = rules.classify(*[F.col(c) for c in ("temperature", "humidity", "pressure", "precipitation")])
    return readings(spark, sf_dir).select(
        "event_id", rules.precipitation_icon(F.col("precipitation")).alias("icon"),
        rules.describe(F.col("weather_main")).alias("description"), rule.alias("by_rule"),
    )


@query("clipped_measures", "P12", sql_with(ctes("readings"), body="""
    SELECT event_id, LEAST(95, GREATEST(20, humidity)) AS humidity,
           LEAST(1040, GREATEST(980, pressure)) AS pressure, LEAST(15, GREATEST(0.5, wind_speed)) AS wind_speed
    FROM readings"""))
def clipped_measures(spark, sf_dir):
    return readings(spark, sf_dir).select("event_id", *[rules.clip_measure(c).alias(c) for c in rules.BOUNDS])


@query("standard_columns", "P3", sql_with(ctes("readings"), body="""
    SELECT city, date, temperature, humidity, pressure, CAST(NULL AS DOUBLE) AS wind_speed, precipitation,
           wind_speed AS cloud_cover, CAST(NULL AS BOOLEAN) AS is_holiday, CAST(NULL AS BOOLEAN) AS is_weekend,
           'open' AS data_source FROM readings"""))
def standard_columns(spark, sf_dir):
    raw = readings(spark, sf_dir).select(
        "city", "date", F.col("temperature").alias("temperature_2m"), F.col("humidity").alias("relativehumidity_2m"),
        F.col("pressure").alias("pressure_msl"), "precipitation", F.col("wind_speed").alias("cloudcover"),
        F.lit("x").alias("data_source"),
    )
    return climate.standardise(raw, "open")


DAILY_FORECAST = """type_counts AS (
    SELECT city, date, weather_main, COUNT(*) AS n FROM readings GROUP BY city, date, weather_main),
modal AS (SELECT city, date, weather_main FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY city, date ORDER BY n DESC, weather_main) AS rn FROM type_counts) WHERE rn = 1),
daily_forecast AS (
    SELECT city, date, AVG(temperature) AS temperature, MIN(temperature) AS temp_min, MAX(temperature) AS temp_max,
           AVG(humidity) AS humidity, AVG(pressure) AS pressure, AVG(wind_speed) AS wind_speed,
           SUM(precipitation) AS precipitation, ANY_VALUE(modal.weather_main) AS weather_main,
           CASE WHEN COUNT(DISTINCT data_source) > 1 THEN 'mixed' ELSE MIN(data_source) END AS data_source,
           isodow(date) >= 6 AS is_weekend, COUNT(*) AS n_readings,
           LEAST(95, GREATEST(70, 100 - ABS(MAX(temperature) - MIN(temperature)) * 5)) AS temp_confidence
    FROM readings JOIN modal USING (city, date) GROUP BY city, date)"""
_ROLLED = ["temperature", "humidity", "pressure", "wind_speed", "temp_confidence"]


@query("daily_forecast", "A9 D1", sql_with(ctes("readings"), DAILY_FORECAST, body=f"""
    SELECT * EXCLUDE (n_readings) REPLACE ({_measures_sql(_ROLLED)}, {half_up('precipitation', 2)} AS precipitation)
    FROM daily_forecast"""))
def daily_forecast(spark, sf_dir):
    return rounded(rounded(climate.daily_forecast(readings(spark, sf_dir)), 4, *_ROLLED), 2, "precipitation")


@query("climate_summary", "A7", sql_with(ctes("climate_full"), body="""
    SELECT city, MIN(date) AS start, MAX(date) AS end, COUNT(*) AS total_days,
           ROUND(AVG(temperature), 4) AS temperature_mean, MIN(temperature) AS temperature_min,
           MAX(temperature) AS temperature_max, ROUND(STDDEV_SAMP(temperature), 4) AS temperature_std,
           ROUND(AVG(humidity), 4) AS humidity_mean, MIN(humidity) AS humidity_min, MAX(humidity) AS humidity_max,
           ROUND(SUM(precipitation), 2) AS precipitation_total, MAX(precipitation) AS precipitation_max,
           COUNT(*) FILTER (WHERE precipitation > 0) AS rainy_days,
           ROUND(1 - CAST(GREATEST(COUNT(*) - COUNT(temperature), COUNT(*) - COUNT(humidity),
                          COUNT(*) - COUNT(precipitation)) AS DOUBLE) / COUNT(*), 6) AS data_completeness
    FROM climate_full WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-27' GROUP BY city"""))
def climate_summary(spark, sf_dir):
    out = climate.climate_summary(climate_full(spark, sf_dir), dt.date(2024, 1, 3), dt.date(2024, 1, 27))
    out = rounded(out, 4, "temperature_mean", "temperature_std", "humidity_mean")
    return rounded(rounded(out, 2, "precipitation_total"), 6, "data_completeness")


_TENTH = {c: half_up(f"AVG({c})", 1) for c in ("temperature", "humidity", "pressure", "wind_speed")}


@query("city_summary", "A8 AR1", sql_with(
    ctes("climate_full"), """types AS (
    SELECT city, STRING_AGG(weather_main || ':' || CAST(n AS VARCHAR), ',' ORDER BY weather_main) AS weather_types
    FROM (SELECT city, weather_main, COUNT(*) AS n FROM climate_full WHERE weather_main IS NOT NULL
          GROUP BY city, weather_main) GROUP BY city)""",
    body=f"""
    SELECT city, COUNT(*) AS total_days, {_TENTH['temperature']} AS temperature_mean,
           {half_up('MAX(temperature)', 1)} AS temperature_max, {half_up('MIN(temperature)', 1)} AS temperature_min,
           {half_up('STDDEV_SAMP(temperature)', 1)} AS temperature_std, {_TENTH['humidity']} AS humidity_mean,
           {half_up('MAX(humidity)', 1)} AS humidity_max, {half_up('MIN(humidity)', 1)} AS humidity_min,
           {_TENTH['pressure']} AS pressure_mean, {half_up('MAX(pressure)', 1)} AS pressure_max,
           {half_up('MIN(pressure)', 1)} AS pressure_min, {_TENTH['wind_speed']} AS wind_speed_mean,
           {half_up('MAX(wind_speed)', 1)} AS wind_speed_max, {half_up('SUM(precipitation)', 1)} AS precipitation_total,
           COUNT(*) FILTER (WHERE precipitation > 0) AS precipitation_days,
           COUNT(*) FILTER (WHERE is_holiday) AS holidays, COUNT(*) FILTER (WHERE is_weekend) AS weekends,
           100 - CAST(FLOOR(CAST(COUNT(*) - COUNT(temperature) + COUNT(*) - COUNT(humidity) AS DOUBLE)
                            / (COUNT(*) * 11) * 100) AS BIGINT) AS data_quality,
           ANY_VALUE(weather_types) AS weather_types
    FROM climate_full JOIN types USING (city) GROUP BY city"""))
def city_summary(spark, sf_dir):
    out = climate.city_summary(climate_full(spark, sf_dir))
    entries = F.transform(F.map_entries("weather_types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return out.withColumn("weather_types", F.array_join(F.array_sort(entries), ","))


@query("city_mean_and_max", "A18", sql_with(ctes("readings"), DAILY_FORECAST, body="""
    SELECT city, ROUND(AVG(temp_max), 4) AS mean_temp_max, MAX(temp_max) AS max_temp_max FROM daily_forecast GROUP BY city"""))
def city_mean_and_max(spark, sf_dir):
    daily = climate.daily_forecast(readings(spark, sf_dir))
    return rounded(climate.mean_and_max(daily, "temp_max"), 4, "mean_temp_max")


BY_REGION = """by_region AS (
    SELECT region, date, AVG(temperature) AS temperature, AVG(humidity) AS humidity, AVG(pressure) AS pressure,
           AVG(wind_speed) AS wind_speed, SUM(precipitation) AS precipitation
    FROM (SELECT city, date, AVG(temperature) AS temperature, AVG(humidity) AS humidity, AVG(pressure) AS pressure,
                 AVG(wind_speed) AS wind_speed, SUM(precipitation) AS precipitation
          FROM climate_daily GROUP BY city, date) JOIN city_regions USING (city) GROUP BY region, date)"""


@query("climate_by_region", "J2", sql_with(ctes("climate_full", "city_regions"), BY_REGION.replace("climate_daily", "climate_full"), body=f"""
    SELECT region, date, {_measures_sql()} FROM by_region"""))
def climate_by_region(spark, sf_dir):
    out = climate.by_region(climate_full(spark, sf_dir), city_regions(spark, sf_dir))
    return rounded(out, 4, *MEASURES)


@query("climate_enrichment", "J1 J2 G1", sql_with(
    ctes("climate_daily", "city_regions", "event_regions"), BY_REGION,
    "joined AS (SELECT * FROM event_regions LEFT JOIN by_region USING (region, date))",
    interpolate_sql("enriched", "joined", "region", MEASURES, True),
    body=f"SELECT region, date, value, {_measures_sql()} FROM enriched"))
def climate_enrichment(spark, sf_dir):
    regional = climate.by_region(climate_daily(spark, sf_dir), city_regions(spark, sf_dir))
    return rounded(climate.enrich(event_regions(spark, sf_dir), regional), 4, *MEASURES)


@query("holiday_climate", "J6 P3 A9", sql_with(ctes("readings", "holiday_dates"), DAILY_FORECAST, body="""
    SELECT city, date, ROUND(temperature, 4) AS temperature, ROUND(humidity, 4) AS humidity,
           ROUND(pressure, 4) AS pressure, ROUND(wind_speed, 4) AS wind_speed, ROUND(precipitation, 2) AS precipitation,
           CAST(NULL AS DOUBLE) AS cloud_cover, date IN (SELECT date FROM holiday_dates) AS is_holiday, is_weekend,
           'events' AS data_source FROM daily_forecast"""))
def holiday_climate(spark, sf_dir):
    out = plans.standard_daily(readings(spark, sf_dir), "events", holiday_dates(spark, sf_dir))
    return rounded(rounded(out, 4, "temperature", "humidity", "pressure", "wind_speed"), 2, "precipitation")


def _provider_a(spark, sf_dir):
    """Daily climate, most days."""
    return climate_daily(spark, sf_dir).select("city", "date", "temperature", "humidity", "pressure")


def _provider_b(spark, sf_dir):
    """Daily extremes of the same cities, other days missing."""
    return readings(spark, sf_dir).filter(F.dayofmonth("date") % 6 != 0).groupBy("city", "date").agg(
        F.max("temperature").alias("temperature"), F.max("humidity").alias("humidity"),
        F.min("pressure").alias("pressure"),
    )


PROVIDERS = """provider_a AS (SELECT city, date, temperature, humidity, pressure FROM climate_daily),
provider_b AS (SELECT city, date, MAX(temperature) AS temperature, MAX(humidity) AS humidity, MIN(pressure) AS pressure
    FROM readings WHERE day(date) % 6 <> 0 GROUP BY city, date)"""


@query("compare_sources", "J8", sql_with(ctes("climate_daily"), PROVIDERS, body="""
    SELECT city, date, a.temperature AS temperature_a, a.humidity AS humidity_a, a.pressure AS pressure_a,
           b.temperature AS temperature_b, b.humidity AS humidity_b, b.pressure AS pressure_b,
           ROUND(a.temperature - b.temperature, 4) AS temperature_diff, ROUND(a.humidity - b.humidity, 4) AS humidity_diff,
           ROUND(a.pressure - b.pressure, 4) AS pressure_diff
    FROM provider_a AS a FULL OUTER JOIN provider_b AS b USING (city, date)"""))
def compare_sources(spark, sf_dir):
    out = climate.compare_sources(_provider_a(spark, sf_dir), _provider_b(spark, sf_dir))
    return rounded(out, 4, "temperature_diff", "humidity_diff", "pressure_diff")


@query("fail_over", "J9", sql_with(ctes("climate_daily"), PROVIDERS, body="""
    SELECT city, date, CASE WHEN a.pressure IS NOT NULL THEN a.temperature ELSE b.temperature END AS temperature,
           CASE WHEN a.pressure IS NOT NULL THEN a.humidity ELSE b.humidity END AS humidity,
           CASE WHEN a.pressure IS NOT NULL THEN 'primary' ELSE 'secondary' END AS data_source
    FROM provider_a AS a FULL OUTER JOIN provider_b AS b USING (city, date)"""))
def fail_over(spark, sf_dir):
    return climate.fail_over(_provider_a(spark, sf_dir), _provider_b(spark, sf_dir), ["temperature", "humidity"])


@query("union_with_precedence", "S3", sql_with(ctes("climate_daily"), PROVIDERS, body="""
    SELECT city, date, temperature, humidity, pressure FROM provider_a
    UNION ALL SELECT city, date, temperature, humidity, pressure FROM provider_b
    WHERE (city, date) NOT IN (SELECT (city, date) FROM provider_a)"""))
def union_with_precedence(spark, sf_dir):
    return climate.union_preferring(_provider_a(spark, sf_dir), _provider_b(spark, sf_dir))


@query("request_horizon", "S4 S3", sql_with(ctes("climate_daily"), PROVIDERS, body="""
    SELECT city, date, temperature, humidity, pressure FROM provider_a
    WHERE date > DATE '2024-01-17' AND date <= DATE '2024-01-20'
    UNION ALL SELECT city, date, temperature, humidity, pressure FROM provider_b
    WHERE date > DATE '2024-01-20' AND date <= DATE '2024-01-24'"""))
def request_horizon(spark, sf_dir):
    return climate.horizon(_provider_a(spark, sf_dir), _provider_b(spark, sf_dir), dt.date(2024, 1, 20), 7)


@query("overlap_days", "S6", sql_with(ctes("climate_daily"), PROVIDERS, body="""
    SELECT date FROM provider_a INTERSECT SELECT date FROM provider_b"""))
def overlap_days(spark, sf_dir):
    return climate.overlap_days(_provider_a(spark, sf_dir), _provider_b(spark, sf_dir))


@query("complete_climate", "S3 G2 P3 S5", sql_with(
    ctes("climate_daily"), """both_providers AS (
    SELECT city, date, temperature, humidity, pressure FROM climate_daily
    UNION ALL SELECT city, date, temperature, humidity, pressure FROM (
        SELECT city, date, MAX(temperature) AS temperature, MAX(humidity) AS humidity, MIN(pressure) AS pressure
        FROM readings WHERE day(date) % 6 <> 0 GROUP BY city, date)
    WHERE (city, date) NOT IN (SELECT (city, date) FROM climate_daily))""",
    interpolate_sql("completed", "both_providers", "city", ["temperature", "humidity", "pressure"], False),
    body=f"SELECT city, date, {_measures_sql(['temperature', 'humidity', 'pressure'])} FROM completed"))
def complete_climate(spark, sf_dir):
    history = climate.standardise(_provider_a(spark, sf_dir), "a")
    forecast = climate.standardise(_provider_b(spark, sf_dir), "b")
    out = plans.complete(history, forecast).select("city", "date", "temperature", "humidity", "pressure")
    return rounded(out, 4, "temperature", "humidity", "pressure")


def _land(df, name):
    """Write one document per row, by city, as a provider's landed folder, and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy("city").text(path)
    return payloads.read_payloads(df.sparkSession, path)


def _daily_documents(spark, sf_dir):
    """Documents with a bounded number of days each, and two broken ones for each city."""
    daily = climate.daily_forecast(readings(spark, sf_dir)).withColumn("part", F.floor((F.dayofmonth("date") - 1) / 5))
    days = F.array_sort(F.collect_list(F.struct("date", "temp_max", "temp_min", "precipitation")))
    grouped = daily.groupBy("city", "part").agg(days.alias("d"))
    block = F.struct(
        F.transform("d", lambda r: r["date"].cast("string")).alias("time"),
        F.col("d.temp_max").alias("temperature_2m_max"), F.col("d.temp_min").alias("temperature_2m_min"),
        F.transform("d", lambda r: F.round(r["precipitation"], 2)).alias("precipitation_sum"),
    )
    good = F.to_json(F.struct(block.alias("daily")))
    whole = grouped.select("city", good.alias("value"))
    broken = grouped.select("city").distinct().select("city", F.explode(F.array(F.lit('{"error": true}'), F.lit("not json"))).alias("value"))
    return whole.unionByName(broken)


@query("daily_payload_rows", "IO8 JS1 AR1", sql_with(ctes("readings"), DAILY_FORECAST, body="""
    SELECT city, date, temp_max AS max_temperature, temp_min AS min_temperature,
           ROUND(precipitation, 2) AS precipitation, 'forecast' AS data_type
    FROM daily_forecast"""))
def daily_payload_rows(spark, sf_dir):
    return payloads.parse_daily(_land(_daily_documents(spark, sf_dir), "daily"), "forecast")[0]


@query("daily_payload_rejects", "IO8 S5", sql_with(ctes("readings"), body="""
    SELECT city, payload, 'no daily block' AS error FROM (SELECT DISTINCT city FROM readings)
    CROSS JOIN (VALUES ('{"error": true}'), ('not json')) AS b(payload)"""))
def daily_payload_rejects(spark, sf_dir):
    return payloads.parse_daily(_land(_daily_documents(spark, sf_dir), "daily"))[1]


def _reading_documents(spark, sf_dir):
    """Documents of up to 40 readings each; every third reading has no rain entry."""
    rows = readings(spark, sf_dir)
    item = F.struct(
        F.unix_seconds(utc_instant(rows, "ts")).alias("dt"),
        F.struct(F.col("temperature").alias("temp"), "humidity", "pressure").alias("main"),
        F.struct(F.col("wind_speed").alias("speed")).alias("wind"),
        F.when(F.col("event_id") % 3 != 0, F.struct(F.col("precipitation").alias("3h"))).alias("rain"),
        F.array(F.struct(F.col("weather_main").alias("main"), rules.describe(F.col("weather_main")).alias("description")),
                F.struct(F.lit("Mist").alias("main"), F.lit("x").alias("description"))).alias("weather"),
    )
    rows = rows.withColumn("item", item).withColumn("part", F.floor(F.col("event_id") / 40))
    return rows.groupBy("city", "part").agg(F.collect_list("item").alias("list")).select(
        "city", F.to_json(F.struct("list")).alias("value")
    )


@query("reading_payload_rows", "IO9 JS1 AR1", sql_with(ctes("readings", "holiday_dates"), """local AS (
    SELECT * REPLACE (CAST(CASE WHEN length(city) % 2 = 0 THEN ts + INTERVAL 8 HOUR ELSE ts END AS DATE) AS date) FROM readings)""", body="""
    SELECT city, CAST(floor(epoch(ts)) AS BIGINT) AS dt, date, date IN (SELECT date FROM holiday_dates) AS is_holiday, temperature, humidity, pressure, wind_speed,
           CASE WHEN event_id % 3 <> 0 THEN precipitation ELSE 0 END AS precipitation, weather_main,
           CASE weather_main WHEN 'Clear' THEN '晴天' WHEN 'Clouds' THEN '多云' WHEN 'Rain' THEN '雨天'
                WHEN 'Snow' THEN '雪天' ELSE '小雨' END AS weather_description,
           isodow(date) >= 6 AS is_weekend, 'api' AS data_source FROM local"""))
def reading_payload_rows(spark, sf_dir):
    """Cities whose name has an even length are eight hours ahead."""
    zone = F.when(F.length("city") % 2 == 0, "Asia/Shanghai").otherwise("UTC")
    zones = city_regions(spark, sf_dir).select("city", zone.alias("timezone"))
    landed = _land(_reading_documents(spark, sf_dir), "readings")
    rows = payloads.parse_readings(landed, zones=zones, holidays=holiday_dates(spark, sf_dir))[0]
    return rows.withColumn("dt", F.unix_seconds("ts")).drop("ts")


@query("city_search_hits", "IO10 JS1", """
    SELECT 'C' || CAST(c_custkey AS VARCHAR) AS city,
           CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'C' || CAST(c_custkey AS VARCHAR) END END AS name,
           CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal / 100 END AS lat,
           CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS lon,
           CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'UTC' ELSE 'Asia/Shanghai' END END AS timezone
    FROM customer""")
def city_search_hits(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    hit = F.struct(
        F.when(key % 2 == 0, F.col("c_name")).alias("name"), (F.col("c_acctbal") / 100).alias("latitude"),
        F.col("c_nationkey").cast("double").alias("longitude"), F.when(key % 3 == 0, "UTC").alias("timezone"),
    )
    results = F.when(key % 5 == 0, F.array().cast(f"array<{hit_type}>")).otherwise(F.array(hit, hit))
    documents = customers.select(
        F.concat(F.lit("C"), key.cast("string")).alias("city"), F.to_json(F.struct(results.alias("results"))).alias("payload")
    )
    return payloads.parse_city_hits(documents)


hit_type = "struct<name:string,latitude:double,longitude:double,timezone:string>"


@query("snapshot_rows", "IO7", sql_with(ctes("climate_full"), body="""
    SELECT city, date, CASE WHEN date >= DATE '2024-01-12' THEN temperature + 1 ELSE temperature END AS temperature,
           humidity, pressure, wind_speed, precipitation, CAST(NULL AS DOUBLE) AS cloud_cover,
           is_holiday, is_weekend, 'a' AS data_source FROM climate_full
    WHERE city IN ('click', 'view') AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"""))
def snapshot_rows(spark, sf_dir):
    path = fresh_path(spark, "snapshot")
    rows = climate_full(spark, sf_dir)
    snapshots.save_snapshot(climate.standardise(rows, "a"), path, "a")
    snapshots.save_snapshot(climate.standardise(rows, "b"), path, "b")
    # part of the days is saved again with other values
    again = rows.filter(F.col("date") >= F.lit("2024-01-12").cast("date")).withColumn("temperature", F.col("temperature") + 1)
    snapshots.save_snapshot(climate.standardise(again, "a"), path, "a")
    return snapshots.load_snapshot(
        spark, path, "a", ["click", "view"], dt.date(2024, 1, 5), dt.date(2024, 1, 20)
    )
