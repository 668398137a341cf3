"""The relations the queries run on, derived from the given tables; each also as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import climate as rules
from ..functions.numeric import half_up
from ..operators import clean

KEY = ["customer_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_series(df: DataFrame, key: list[str]) -> DataFrame:
    """Totals per key and day, in cents."""
    return clean.daily_series(df, key).withColumn("value", F.round("value", 2))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as customer readings: several rows per customer and day."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("region"),
        F.col("ts").cast("date").alias("date"), "value", F.col("event_id").alias("seq"),
    )


def cust_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_series(raw_events(spark, sf_dir), ["customer_id", "region"])


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("c_custkey").cast("string").alias("customer_id"), "region")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as customer values with region: several rows per customer and day, many per region and day."""
    orders = _orders(spark, sf_dir, F.col("o_orderkey").alias("seq"))
    return orders.join(customer_regions(spark, sf_dir), KEY).select("customer_id", "region", "date", "value", "seq")


def _orders(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("value"), *more,
    )


def cust_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per customer and day; added up before the region is looked up.

    So a customer with very many orders brings at most one row per day to the join, and the
    join leaves the rows partitioned by customer, as the windows over customers need them.
    """
    daily = daily_series(_orders(spark, sf_dir), KEY)
    return daily.join(customer_regions(spark, sf_dir), KEY).select("customer_id", "region", "date", "value")


def region_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_series(cust_orders(spark, sf_dir), ["region"])


def event_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event totals per region and day; the region names match those of :func:`city_regions`."""
    return daily_series(raw_events(spark, sf_dir), ["region"])


def nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer series with leading and inner nulls."""
    day = F.dayofmonth("date")
    return cust_events(spark, sf_dir).withColumn("value", F.when((day != 1) & (day % 4 != 0), F.col("value")))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer series with nulls and with missing days, for the operators that lay out days."""
    return nulled(spark, sf_dir).filter(F.dayofmonth("date") % 9 != 0)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as climate readings of five cities."""
    return readings_of(table(spark, sf_dir, "events"))


def readings_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    rows = events.select(
        F.col("event_type").alias("city"), "ts", F.col("ts").cast("date").alias("date"),
        F.col("value").alias("temperature"), k.alias("humidity"),
        (1000 + F.col("event_id") % 31).cast("double").alias("pressure"),
        ((F.col("event_id") % 23) / 2.0).alias("wind_speed"),
        F.round(F.greatest(F.col("value") - 50, F.lit(0.0)), 2).alias("precipitation"),
        F.when(F.col("event_id") % 7 == 0, "simulated").otherwise("api").alias("data_source"), "event_id",
    )
    by_rule = rules.classify(*[F.col(c) for c in ("temperature", "humidity", "pressure", "precipitation")])
    otherwise = F.when(F.col("event_id") % 2 == 0, "Clear").otherwise("Drizzle")
    return rows.withColumn("weather_main", F.coalesce(by_rule, otherwise))


def climate_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City climate by day with every seventh day missing, for the operators that fill or compare days."""
    return climate_full(spark, sf_dir).filter(F.dayofmonth("date") % 7 != 0)


def climate_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City climate by day with nulls by a rule on the date."""
    day = F.dayofmonth("date")
    daily = readings(spark, sf_dir).groupBy("city", "date").agg(
        half_up(F.avg("temperature"), 4).alias("temperature"), half_up(F.avg("humidity"), 4).alias("humidity"),
        half_up(F.avg("pressure"), 4).alias("pressure"), half_up(F.avg("wind_speed"), 4).alias("wind_speed"),
        F.round(F.sum("precipitation"), 2).alias("precipitation"),
        F.when(F.max("precipitation") > 150, "Rain").when(F.max("pressure") > 1029, "Clear").otherwise("Clouds")
        .alias("weather_main"),
    )
    return (
        daily.withColumn("temperature", F.when(day % 5 != 0, F.col("temperature")))
        .withColumn("humidity", F.when(day % 4 != 1, F.col("humidity")))
        .withColumn("is_holiday", day.isin(1, 15)).withColumn("is_weekend", F.weekday("date") >= 5)
        .withColumn("data_source", F.lit("api"))
    )


def city_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each city, from the cities that occur."""
    cities = table(spark, sf_dir, "events").select(F.col("event_type").alias("city")).distinct()
    return cities.withColumn("region", F.concat(F.lit("R"), (F.length("city") % 5).cast("string")))


def holiday_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A holiday calendar: the first and the fifteenth of each month that has events."""
    return table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date")).distinct().filter(
        F.dayofmonth("date").isin(1, 15)
    )


def ctes(*names: str) -> str:
    """The named relations and what they need, in order, ready for ``WITH``."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return ",\n".join(f"{n} AS ({_SQL[n]})" for n in order)


_NEEDS = {
    "cust_events": ("raw_events",),
    "raw_orders": ("customer_regions",), "cust_orders": ("raw_orders",), "region_daily": ("raw_orders",),
    "event_regions": ("raw_events",), "nulled": ("cust_events",), "holed": ("nulled",),
    "climate_full": ("readings",), "climate_daily": ("climate_full",),
}

_SQL = {
    "raw_events": """
        SELECT CAST(user_id AS VARCHAR) AS customer_id, 'R' || CAST(user_id % 5 AS VARCHAR) AS region,
               CAST(ts AS DATE) AS date, value, event_id AS seq FROM events""",
    "cust_events": """
        SELECT customer_id, region, date, ROUND(SUM(value), 2) AS value FROM raw_events
        GROUP BY customer_id, region, date""",
    "customer_regions": """
        SELECT c_custkey, r_name AS region FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "raw_orders": """
        SELECT CAST(o_custkey AS VARCHAR) AS customer_id, region, CAST(o_orderdate AS DATE) AS date,
               o_totalprice AS value, o_orderkey AS seq
        FROM orders JOIN customer_regions ON o_custkey = c_custkey""",
    "cust_orders": """
        SELECT customer_id, region, date, ROUND(SUM(value), 2) AS value FROM raw_orders
        GROUP BY customer_id, region, date""",
    "region_daily": """
        SELECT region, date, ROUND(SUM(value), 2) AS value FROM raw_orders GROUP BY region, date""",
    "event_regions": """
        SELECT region, date, ROUND(SUM(value), 2) AS value FROM raw_events GROUP BY region, date""",
    "nulled": """
        SELECT customer_id, region, date,
               CASE WHEN day(date) <> 1 AND day(date) % 4 <> 0 THEN value END AS value FROM cust_events""",
    "holed": "SELECT * FROM nulled WHERE day(date) % 9 <> 0",
    "climate_daily": "SELECT * FROM climate_full WHERE day(date) % 7 <> 0",
    "readings": """
        SELECT *, CASE WHEN precipitation > 5 THEN CASE WHEN temperature > 0 THEN 'Rain' ELSE 'Snow' END
                       WHEN humidity > 80 AND pressure < 1010 THEN 'Clouds'
                       WHEN humidity < 40 AND pressure > 1020 THEN 'Clear'
                       WHEN event_id % 2 = 0 THEN 'Clear' ELSE 'Drizzle' END AS weather_main
        FROM (SELECT event_type AS city, ts, CAST(ts AS DATE) AS date, value AS temperature,
                     CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS humidity,
                     CAST(1000 + event_id % 31 AS DOUBLE) AS pressure,
                     CAST(event_id % 23 AS DOUBLE) / 2 AS wind_speed,
                     ROUND(GREATEST(value - 50, 0), 2) AS precipitation,
                     CASE WHEN event_id % 7 = 0 THEN 'simulated' ELSE 'api' END AS data_source, event_id
              FROM events)""",
    "climate_full": """
        SELECT city, date, CASE WHEN day(date) % 5 <> 0 THEN t END AS temperature,
               CASE WHEN day(date) % 4 <> 1 THEN h END AS humidity, pressure, wind_speed, precipitation,
               weather_main, day(date) IN (1, 15) AS is_holiday, isodow(date) >= 6 AS is_weekend, 'api' AS data_source
        FROM (SELECT city, date, ROUND(AVG(temperature), 4) AS t, ROUND(AVG(humidity), 4) AS h,
                     ROUND(AVG(pressure), 4) AS pressure, ROUND(AVG(wind_speed), 4) AS wind_speed,
                     ROUND(SUM(precipitation), 2) AS precipitation,
                     CASE WHEN MAX(precipitation) > 150 THEN 'Rain' WHEN MAX(pressure) > 1029 THEN 'Clear'
                          ELSE 'Clouds' END AS weather_main
              FROM readings GROUP BY city, date)""",
    "city_regions": """
        SELECT city, 'R' || CAST(length(city) % 5 AS VARCHAR) AS region
        FROM (SELECT DISTINCT event_type AS city FROM events)""",
    "holiday_dates": """
        SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE day(CAST(ts AS DATE)) IN (1, 15)""",
}
