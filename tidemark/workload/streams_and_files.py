"""Streams, tabular sources and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import anomaly
from ..plans import ingest
from ..schema import MAIN
from ..sources import reports as report_sink
from ..sources import tabular, versions
from ..storage import fresh_path
from ..streaming import alerts, rollup
from ..streaming.run import file_stream, run_available, run_updates
from .cleaning import FIRST_MAIN
from .customers import ALERTS_BODY, TOP, analysis_sql
from .inputs import ctes, cust_events, cust_orders, event_regions, raw_orders, readings, readings_of, region_daily, table
from .registry import half_up, query, rounded, sql_with
from .climate import DAILY_FORECAST


def _event_stream(spark, sf_dir):
    return file_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)


@query("streamed_alerts", "X1", sql_with(ctes("cust_events"), """history AS (
    SELECT *, AVG(value) OVER e AS mu, STDDEV_SAMP(value) OVER e AS sd,
           LEAD(date) OVER (PARTITION BY customer_id ORDER BY date) AS next_date
    FROM (SELECT *, MAX(date) OVER (PARTITION BY customer_id) AS latest FROM cust_events) WHERE date >= latest - INTERVAL 3 DAY
    WINDOW e AS (PARTITION BY customer_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", body="""
    SELECT customer_id, 'real_time' AS alert_type, date, value AS latest_value, ROUND(ABS(value - mu) / sd, 4) AS z_score
    FROM history WHERE next_date IS NULL AND sd > 1e-9 * GREATEST(1, ABS(mu)) AND ABS(value - mu) / sd > 2"""))
def streamed_alerts(spark, sf_dir):
    stream = _event_stream(spark, sf_dir).withColumnRenamed("user_id", "customer_id")
    verdicts = run_updates(alerts.daily_verdicts(stream), "alerts")
    return rounded(rounded(alerts.current_alerts(verdicts), 4, "z_score"), 2, "latest_value").drop("expected_range")


@query("streamed_daily_rollup", "X2", sql_with(ctes("readings"), DAILY_FORECAST, body=f"""
    SELECT city, date, temp_min, temp_max, {half_up('temperature', 4)} AS temperature, {half_up('humidity', 4)} AS humidity,
           {half_up('pressure', 4)} AS pressure, {half_up('wind_speed', 4)} AS wind_speed,
           {half_up('precipitation', 2)} AS precipitation, weather_main, n_readings, data_source, is_weekend,
           {half_up('temp_confidence', 4)} AS temp_confidence
    FROM daily_forecast WHERE date + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 3 HOUR FROM readings)"""))
def streamed_daily_rollup(spark, sf_dir):
    out = run_available(rollup.daily_rollup(readings_stream(spark, sf_dir)), "rollup")
    out = rounded(out, 4, "temperature", "humidity", "pressure", "wind_speed", "temp_confidence")
    return rounded(out, 2, "precipitation")


def readings_stream(spark, sf_dir):
    """The readings relation, over a stream of the events file."""
    return readings_of(_event_stream(spark, sf_dir))


@query("csv_round_trip", "IO1 IO2 IO3", sql_with(ctes("region_daily"), body="""
    SELECT region, CASE WHEN day(date) <> 13 THEN date END AS date, value FROM region_daily"""))
def csv_round_trip(spark, sf_dir):
    path = fresh_path(spark, "main-csv")
    text = F.when(F.dayofmonth("date") != 13, F.date_format("date", "yyyy-MM-dd")).otherwise("bad date")
    tabular.write_table(region_daily(spark, sf_dir).withColumn("date", text), path, "csv")
    return tabular.read_if_there(spark, path, MAIN, date_columns=["date"])


@query("partitioned_store", "IO3 A21", sql_with(ctes("raw_orders"), FIRST_MAIN, body="""
    SELECT region, date, value, '20240131_120000' AS run_ts FROM first_main
    UNION ALL SELECT region, date, value, '20240201_120000' FROM first_main WHERE region < 'B'
    UNION ALL SELECT region, date, value, '20240201_120000' FROM first_main WHERE region >= 'M'"""))
def partitioned_store(spark, sf_dir):
    """A run of all regions, and a second run whose regions come one after the other, one of them twice."""
    path = fresh_path(spark, "main")
    raw = raw_orders(spark, sf_dir)
    ingest.store(ingest.import_main(raw, sequence="seq"), path, run_at=dt.datetime(2024, 1, 31, 12))
    for part in ("region < 'B'", "region >= 'M'", "region < 'B'"):
        ingest.store(ingest.import_main(raw.filter(part), sequence="seq"), path, run_at=dt.datetime(2024, 2, 1, 12))
    schema = T.StructType([*MAIN.fields, T.StructField("run_ts", T.StringType())])
    return spark.read.schema(schema).parquet(path).select(*schema.names)


@query("appended_table", "IO5", sql_with(ctes("region_daily", "event_regions"), body="""
    SELECT region, date, value FROM region_daily UNION ALL SELECT region, date, value FROM event_regions"""))
def appended_table(spark, sf_dir):
    path = fresh_path(spark, "appended")
    tabular.append_table(region_daily(spark, sf_dir), path)
    tabular.append_table(event_regions(spark, sf_dir), path)
    return spark.read.schema(MAIN).parquet(path)


@query("sheets", "IO4", sql_with(ctes("region_daily"), body="""
    SELECT 'daily' AS sheet, region, date, value, CAST(NULL AS VARCHAR) AS name FROM region_daily
    UNION ALL SELECT 'nations', CAST(n_regionkey AS VARCHAR), NULL, NULL, n_name FROM nation"""))
def sheets(spark, sf_dir):
    root = fresh_path(spark, "sheets")
    tabular.write_table(region_daily(spark, sf_dir), f"{root}/daily", "csv")
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("region"), F.col("n_name").alias("name"))
    tabular.write_table(nations, f"{root}/nations", "csv")
    return tabular.read_sheets(
        spark, root, {"daily": MAIN, "nations": T.StructType.fromDDL("region string, name string")}, date_columns=["date"]
    )


_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


@query("inventory", "IO11", " UNION ALL ".join(
    f"""SELECT '{t}' AS sheet, (SELECT COUNT(*) FROM {t}) AS n_rows,
    (SELECT CAST(COUNT(*) AS INTEGER) FROM (DESCRIBE {t})) AS n_columns,
    (SELECT STRING_AGG(column_name, ',') FROM (DESCRIBE {t})) AS column_names""" for t in _TABLES))
def inventory(spark, sf_dir):
    found = tabular.inventory({t: table(spark, sf_dir, t) for t in _TABLES})
    return found.drop("n_files", "bytes")  # SQL sees the tables, not their files


@query("table_files", "IO11")
def table_files(spark, sf_dir):
    return tabular.inventory({t: table(spark, sf_dir, t) for t in _TABLES}).select("sheet", "n_rows", "n_files", "bytes")


@query("report_sink_alerts", "IO6", sql_with(analysis_sql("cust_events"), body=ALERTS_BODY))
def report_sink_alerts(spark, sf_dir):
    path = fresh_path(spark, "report")
    report_sink.write_report(anomaly.analyse_customers(cust_events(spark, sf_dir)), path, parts=("top_customers", "alerts"))
    schema = T.StructType.fromDDL(
        "customer_id string, severity string, anomaly_count bigint, latest_anomaly_date date, "
        "latest_anomaly_value double, deviation_from_mean double, z_score double, total_value double"
    )
    out = tabular.read_table(spark, f"{path}/alerts", schema).drop("total_value")
    return rounded(out, 4, "deviation_from_mean", "z_score")


@query("report_sink_top", "IO6", sql_with(ctes("cust_events"), TOP.format(src="cust_events"), body="""
    SELECT customer_id, ROUND(total_value, 2) AS total_value, percentage FROM top"""))
def report_sink_top(spark, sf_dir):
    path = fresh_path(spark, "report")
    report_sink.write_report(anomaly.analyse_customers(cust_events(spark, sf_dir)), path, "parquet", ("top_customers",))
    return rounded(spark.read.parquet(f"{path}/top_customers"), 2, "total_value")


@query("batch_rollup_of_readings", "A9 X2", sql_with(ctes("readings"), DAILY_FORECAST, body="""
    SELECT city, date, n_readings, weather_main, temp_min, temp_max, data_source, is_weekend FROM daily_forecast"""))
def batch_rollup_of_readings(spark, sf_dir):
    return rollup.daily_rollup(readings(spark, sf_dir)).select(
        "city", "date", "n_readings", "weather_main", "temp_min", "temp_max", "data_source", "is_weekend"
    )


@query("changed_keys", "A13 J8", sql_with(ctes("cust_orders"), """newer AS (
    SELECT customer_id, date, CASE WHEN customer_id::BIGINT % 97 = 0 AND day(date) < 8 THEN value + 1 ELSE value END AS value
    FROM cust_orders WHERE customer_id::BIGINT % 101 <> 0
    UNION ALL SELECT 'new-' || customer_id, date, value FROM cust_orders WHERE customer_id::BIGINT % 211 = 0),
older_rows AS (SELECT customer_id, COUNT(*) AS n, list(ROW(date, value) ORDER BY date, value) AS r FROM cust_orders GROUP BY customer_id),
newer_rows AS (SELECT customer_id, COUNT(*) AS n, list(ROW(date, value) ORDER BY date, value) AS r FROM newer GROUP BY customer_id)""", body="""
    SELECT customer_id, CASE WHEN o.n IS NULL THEN 'added' WHEN w.n IS NULL THEN 'removed' ELSE 'changed' END AS change,
           COALESCE(o.n, 0) AS old_rows, COALESCE(w.n, 0) AS new_rows
    FROM older_rows AS o FULL JOIN newer_rows AS w USING (customer_id) WHERE o.r IS DISTINCT FROM w.r"""))
def changed_keys(spark, sf_dir):
    """Two stored versions of the customers' daily values, compared from the roots of their hash trees."""
    older = cust_orders(spark, sf_dir).select("customer_id", "date", "value")
    customer = F.col("customer_id").cast("long")
    raised = F.when((customer % 97 == 0) & (F.dayofmonth("date") < 8), F.col("value") + 1).otherwise(F.col("value"))
    added = older.filter(customer % 211 == 0).withColumn("customer_id", F.concat(F.lit("new-"), F.col("customer_id")))
    newer = older.filter(customer % 101 != 0).withColumn("value", raised).unionByName(added)
    paths = [fresh_path(spark, name) for name in ("older", "newer")]
    for df, path in zip((older, newer), paths):
        versions.store_version(df, path, ["customer_id"])
    return versions.changed_keys(spark, *paths, ["customer_id"])
