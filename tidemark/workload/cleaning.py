"""Import, de-duplication, gates, summaries, quality and profile reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, reports
from ..plans import ingest
from ..schema import check_columns
from .inputs import (
    KEY, ctes, cust_events, cust_orders, event_regions, nulled, raw_orders, region_daily, table, climate_full,
)
from .registry import half_up, query, rounded, sql_with

FIRST_MAIN = """first_main AS (
    SELECT region, date, value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY region, date ORDER BY seq) AS rn FROM raw_orders) WHERE rn = 1)"""
FIRST_CUSTOMERS = """first_customers AS (
    SELECT customer_id, region, date, value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id, region, date ORDER BY seq) AS rn FROM raw_orders)
    WHERE rn = 1)"""


@query("import_main", "P1 S2 W13 S1", sql_with(ctes("raw_orders"), FIRST_MAIN, body="SELECT * FROM first_main"))
def import_main(spark, sf_dir):
    return ingest.import_main(raw_orders(spark, sf_dir), sequence="seq").rows


@query("import_customers", "P2 S2 W13", sql_with(
    ctes("raw_orders"), FIRST_CUSTOMERS, body="SELECT * FROM first_customers"))
def import_customers(spark, sf_dir):
    return ingest.import_customers(raw_orders(spark, sf_dir), sequence="seq").rows


FIRST_TIMES = """timed AS (
    SELECT 'R' || CAST(user_id % 5 AS VARCHAR) AS region, ts, value, event_id FROM events),
first_times AS (
    SELECT region, CAST(ts AS DATE) AS date, value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY region, ts ORDER BY event_id) AS rn FROM timed) WHERE rn = 1)"""


def _timed(spark, sf_dir):
    region = F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string"))
    return table(spark, sf_dir, "events").select(region.alias("region"), F.col("ts").alias("date"), "value", F.col("event_id").alias("seq"))


@query("import_times_of_day", "P1", sql_with(FIRST_TIMES, body="SELECT * FROM first_times"))
def import_times_of_day(spark, sf_dir):
    return ingest.import_main(_timed(spark, sf_dir), sequence="seq").rows


@query("days_of_imported_times", "P1", sql_with(FIRST_TIMES, body="""
    SELECT region, date, ROUND(SUM(value), 2) AS value FROM first_times GROUP BY region, date"""))
def days_of_imported_times(spark, sf_dir):
    rows = ingest.import_main(_timed(spark, sf_dir), sequence="seq").rows
    return rounded(clean.daily_series(rows, ["region"]), 2, "value")


@query("first_without_sequence", "W13 S2", sql_with(ctes("raw_orders"), body="""
    SELECT region, date, value, customer_id FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY region, date ORDER BY customer_id, value) AS rn FROM raw_orders)
    WHERE rn = 1"""))
def first_without_sequence(spark, sf_dir):
    rows = raw_orders(spark, sf_dir).select("region", "date", "customer_id", "value")
    return clean.keep_first(rows, ["region", "date"])


@query("coerced_values", "P1 D4", """
    SELECT p_brand AS region, DATE '2024-01-01' + CAST(p_size AS INTEGER) AS date,
           CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS value,
           CASE WHEN p_size % 4 <> 0 THEN DATE '2024-01-01' + CAST(p_size AS INTEGER) END AS checked, p_partkey AS seq
    FROM part""")
def coerced_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    raw = part.select(
        "p_brand", F.date_format(day, "yyyy-MM-dd").alias("day"), F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") % 3 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string")).alias("price"),
        F.when(F.col("p_size") % 4 == 0, F.lit("2024-13-45")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("bad"),
    )
    main = clean.canonical_main(raw, "day", "price", "p_brand", extra=["bad", "seq"])
    return main.withColumn("checked", clean.to_date(F.col("bad"), "yyyy-MM-dd")).drop("bad")


@query("import_main_envelope", "A21", sql_with(ctes("raw_orders"), FIRST_MAIN, body="""
    SELECT (SELECT COUNT(*) FROM raw_orders) AS original_rows, COUNT(*) AS processed_rows,
           COUNT(DISTINCT region) AS regions, strftime(MIN(date), '%Y-%m-%d') AS start,
           strftime(MAX(date), '%Y-%m-%d') AS end,
           CAST(SUM(CAST('0x' || substr(md5(concat_ws('|', region, CAST(date AS VARCHAR),
                CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR))), 1, 8) AS BIGINT)) AS VARCHAR) AS content_hash
    FROM first_main"""))
def import_main_envelope(spark, sf_dir):
    return ingest.import_main(raw_orders(spark, sf_dir), sequence="seq").envelope


@query("import_customers_envelope", "A21", sql_with(ctes("raw_orders"), FIRST_CUSTOMERS, body="""
    SELECT (SELECT COUNT(*) FROM raw_orders) AS original_rows, COUNT(*) AS processed_rows,
           COUNT(DISTINCT customer_id) AS customers, COUNT(DISTINCT region) AS regions,
           strftime(MIN(date), '%Y-%m-%d') AS start, strftime(MAX(date), '%Y-%m-%d') AS end,
           CAST(SUM(CAST('0x' || substr(md5(concat_ws('|', customer_id, region, CAST(date AS VARCHAR),
                CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR))), 1, 8) AS BIGINT)) AS VARCHAR) AS content_hash
    FROM first_customers"""))
def import_customers_envelope(spark, sf_dir):
    return ingest.import_customers(raw_orders(spark, sf_dir), sequence="seq").envelope


@query("modelling_gate", "P5", sql_with(ctes("nulled"), body="""
    SELECT customer_id, n_rows, n_nulls, reason, reason = 'ok' AS valid FROM (
        SELECT *, CASE WHEN n_rows < 18 THEN 'too_short' WHEN n_nulls > n_rows * 0.25 THEN 'too_many_nulls'
                  ELSE 'ok' END AS reason
        FROM (SELECT customer_id, COUNT(*) AS n_rows, COUNT(*) - COUNT(value) AS n_nulls FROM nulled GROUP BY customer_id))"""))
def modelling_gate(spark, sf_dir):
    return clean.modelling_gate(nulled(spark, sf_dir), KEY, min_rows=18, max_null_share=0.25)


@query("modellable_rows", "P5", sql_with(ctes("region_daily"), body="""
    SELECT * FROM region_daily WHERE region IN (
        SELECT region FROM region_daily GROUP BY region
        HAVING COUNT(*) >= 30 AND COUNT(*) - COUNT(value) <= COUNT(*) * 0.1)"""))
def modellable_rows(spark, sf_dir):
    return clean.modellable(region_daily(spark, sf_dir), ["region"])


@query("last_rows", "P8", sql_with(ctes("cust_orders"), body="""
    SELECT customer_id, region, date, value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date DESC) AS rn FROM cust_orders) WHERE rn <= 3"""))
def last_rows(spark, sf_dir):
    return clean.first_rows(cust_orders(spark, sf_dir), KEY, 3, last=True)


@query("next_rows", "P8", sql_with(ctes("cust_events"), body="""
    SELECT customer_id, region, date, value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date) AS rn
        FROM cust_events WHERE date > DATE '2024-01-15') WHERE rn <= 3"""))
def next_rows(spark, sf_dir):
    coming = clean.after(cust_events(spark, sf_dir), F.lit("2024-01-15").cast("date"))
    return clean.first_rows(coming, KEY, 3)


def _summary_sql(src: str, key: str) -> str:
    return sql_with(ctes(src), body=f"""
    SELECT {key}, COUNT(*) AS total_records, strftime(MIN(date), '%Y-%m-%d') AS start,
           strftime(MAX(date), '%Y-%m-%d') AS end, {half_up('AVG(value)', 2)} AS mean,
           {half_up('STDDEV_SAMP(value)', 2)} AS std, MIN(value) AS min, MAX(value) AS max,
           {half_up('QUANTILE_CONT(value, 0.5)', 2)} AS median,
           COUNT(*) - COUNT(value) AS missing_values, COUNT(*) FILTER (WHERE value = 0) AS zero_values,
           COUNT(*) FILTER (WHERE value < 0) AS negative_values
    FROM {src} GROUP BY {key}""")


@query("main_summary", "A5 D4 M1", _summary_sql("region_daily", "region"))
def main_summary(spark, sf_dir):
    return reports.main_summary(region_daily(spark, sf_dir))


@query("main_summary_with_nulls", "A5", _summary_sql("nulled", "customer_id"))
def main_summary_with_nulls(spark, sf_dir):
    return reports.main_summary(nulled(spark, sf_dir), KEY)


@query("customer_summary_by_region", "A6", sql_with(ctes("cust_orders"), body="""
    SELECT region, COUNT(DISTINCT customer_id) AS customers, ROUND(SUM(value), 2) AS total_value
    FROM cust_orders GROUP BY region"""))
def customer_summary_by_region(spark, sf_dir):
    return rounded(reports.customer_summary_by_region(cust_orders(spark, sf_dir)), 2, "total_value")


@query("customer_summary", "A6", sql_with(ctes("cust_orders"), body="""
    SELECT COUNT(DISTINCT customer_id) AS total_customers, COUNT(DISTINCT region) AS total_regions,
           strftime(MIN(date), '%Y-%m-%d') AS start, strftime(MAX(date), '%Y-%m-%d') AS end FROM cust_orders"""))
def customer_summary(spark, sf_dir):
    return reports.customer_summary(cust_orders(spark, sf_dir))


def _repeated(spark, sf_dir):
    """Line items without their order: many equal rows."""
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query("quality_overview", "A11", """
    SELECT CAST(SUM(n) AS BIGINT) AS total_rows, 5 AS total_columns, CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows
    FROM (SELECT COUNT(*) AS n FROM lineitem
          GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)""")
def quality_overview(spark, sf_dir):
    return reports.quality_report(_repeated(spark, sf_dir)).overview


_REQUIRED = {"events": ["event_id", "ts", "value"], "orders": ["o_orderkey", "o_orderdate", "value"]}


@query("required_columns", "P4", " UNION ALL ".join(
    f"""SELECT '{t}' AS sheet, COUNT(*) = {len(need)} AS is_valid, {len(need)} - CAST(COUNT(*) AS INTEGER) AS n_missing,
    (SELECT STRING_AGG(column_name, ',') FROM (DESCRIBE {t})) AS available_columns, (SELECT COUNT(*) FROM {t}) AS n_rows
    FROM (DESCRIBE {t}) WHERE column_name IN ({', '.join(f"'{c}'" for c in need)})""" for t, need in _REQUIRED.items()))
def required_columns(spark, sf_dir):
    out = None
    for name, need in _REQUIRED.items():
        rows = table(spark, sf_dir, name)
        check = check_columns(rows, need)
        one = rows.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("sheet"), F.lit(check["is_valid"]).alias("is_valid"),
            F.lit(len(check["missing_columns"])).alias("n_missing"),
            F.lit(",".join(check["available_columns"])).alias("available_columns"), "n_rows",
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("quality_columns", "A11", sql_with(ctes("climate_full"), body="""
    SELECT "column", missing, ROUND(missing * 100.0 / total, 2) AS missing_percentage FROM (
        SELECT 'temperature' AS "column", COUNT(*) - COUNT(temperature) AS missing, COUNT(*) AS total FROM climate_full
        UNION ALL SELECT 'humidity', COUNT(*) - COUNT(humidity), COUNT(*) FROM climate_full
        UNION ALL SELECT 'city', COUNT(*) - COUNT(city), COUNT(*) FROM climate_full)"""))
def quality_columns(spark, sf_dir):
    rows = climate_full(spark, sf_dir).select("city", "temperature", "humidity")
    return reports.quality_report(rows).columns.drop("data_type")


NUMERIC_SQL = """
    SELECT '{c}' AS "column", COUNT({c}) AS "count", ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std,
           CAST(MIN({c}) AS DOUBLE) AS min, ROUND(QUANTILE_CONT({c}, 0.25), 4) AS p25,
           ROUND(QUANTILE_CONT({c}, 0.5), 4) AS p50, ROUND(QUANTILE_CONT({c}, 0.75), 4) AS p75,
           CAST(MAX({c}) AS DOUBLE) AS max FROM {t}"""


@query("quality_numbers", "A11", " UNION ALL ".join(
    NUMERIC_SQL.format(c=c, t="lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def quality_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(reports.quality_report(rows).numeric, 4, "mean", "std", "p25", "p50", "p75")


@query("quality_dates", "A11 D4", """
    SELECT 'o_orderdate' AS "column", strftime(MIN(o_orderdate), '%Y-%m-%d') AS min,
           strftime(MAX(o_orderdate), '%Y-%m-%d') AS max,
           datediff('day', CAST(MIN(o_orderdate) AS DATE), CAST(MAX(o_orderdate) AS DATE)) AS range_days FROM orders""")
def quality_dates(spark, sf_dir):
    return reports.quality_report(table(spark, sf_dir, "orders")).dates


PROFILE_SQL = """
    SELECT '{c}' AS "column", CAST(SUM(n) AS BIGINT) AS "count", COUNT(*) AS "unique",
           ARG_MIN(v, ROW(-n, v)) AS top, MAX(n) AS freq
    FROM (SELECT CAST({c} AS VARCHAR) AS v, COUNT(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)"""


@query("value_profile", "A12", " UNION ALL ".join(
    PROFILE_SQL.format(c=c, t="customer") for c in ("c_name", "c_mktsegment", "c_nationkey")))
def value_profile(spark, sf_dir):
    return reports.value_profile(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_nationkey"])


def _profile_sql(c: str, numeric: bool) -> str:
    numbers = (
        f"SELECT ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std, CAST(MIN({c}) AS DOUBLE) AS min, "
        f"QUANTILE_CONT({c}, 0.25) AS p25, QUANTILE_CONT({c}, 0.5) AS p50, QUANTILE_CONT({c}, 0.75) AS p75, "
        f"CAST(MAX({c}) AS DOUBLE) AS max FROM orders"
        if numeric else "SELECT " + ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in
                                              ("mean", "std", "min", "p25", "p50", "p75", "max"))
    )
    return f"""
    SELECT * FROM ({PROFILE_SQL.format(c=c, t="orders")}) AS a,
           (SELECT COUNT(*) - COUNT({c}) AS missing, ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2)
            AS missing_percentage FROM orders) AS b, ({numbers}) AS c"""


@query("profile_report", "A12 A11", " UNION ALL ".join(
    _profile_sql(c, n) for c, n in (("o_custkey", True), ("o_orderstatus", False), ("o_orderpriority", False))))
def profile_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return rounded(reports.profile_report(rows), 4, "mean", "std").drop("data_type")


# The reports above take a few columns each; these take every column of their tables.
NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
CLIMATE = ("city", "date", "temperature", "humidity", "pressure", "wind_speed", "precipitation", "weather_main", "is_holiday",
           "is_weekend", "data_source")
ORDERS = (("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderdate", False),
          ("o_orderpriority", False))


def _overview_sql(rows: str) -> str:
    return f"""
    SELECT CAST(SUM(n) AS BIGINT) AS total_rows, (SELECT CAST(COUNT(*) AS INTEGER) FROM (DESCRIBE lineitem)) AS total_columns,
           CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows
    FROM (SELECT COUNT(*) AS n FROM ({rows}) AS l GROUP BY l)"""


@query("quality_overview_whole", "A11", _overview_sql("SELECT * FROM lineitem"))
def quality_overview_whole(spark, sf_dir):
    return reports.quality_report(table(spark, sf_dir, "lineitem")).overview


@query("quality_overview_repeated", "A11", _overview_sql("SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1"))
def quality_overview_repeated(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return reports.quality_report(rows.unionAll(rows.filter("l_linenumber = 1"))).overview


@query("quality_columns_whole", "A11", sql_with(ctes("climate_full"), body="""
    SELECT "column", missing, ROUND(missing * 100.0 / total, 2) AS missing_percentage FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing, COUNT(*) AS total FROM climate_full""" for c in CLIMATE) + ")"))
def quality_columns_whole(spark, sf_dir):
    return reports.quality_report(climate_full(spark, sf_dir)).columns.drop("data_type")


@query("quality_numbers_whole", "A11", " UNION ALL ".join(NUMERIC_SQL.format(c=c, t="lineitem") for c in NUMBERS))
def quality_numbers_whole(spark, sf_dir):
    return rounded(reports.quality_report(table(spark, sf_dir, "lineitem")).numeric, 4, "mean", "std", "p25", "p50", "p75")


@query("value_profile_whole", "A12", " UNION ALL ".join(
    PROFILE_SQL.format(c=c, t="customer") for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def value_profile_whole(spark, sf_dir):
    return reports.value_profile(table(spark, sf_dir, "customer"))


@query("profile_report_whole", "A12 A11", " UNION ALL ".join(
    f"SELECT * REPLACE (ROUND(p25, 4) AS p25, ROUND(p50, 4) AS p50, ROUND(p75, 4) AS p75) FROM ({_profile_sql(c, n)})" for c, n in ORDERS))
def profile_report_whole(spark, sf_dir):
    return rounded(reports.profile_report(table(spark, sf_dir, "orders")), 4, "mean", "std", "p25", "p50", "p75").drop("data_type")


@query("content_hash", "A13", sql_with(ctes("cust_events"), body="""
    SELECT region, COUNT(*) AS n_rows,
           CAST(SUM(CAST('0x' || substr(md5(concat_ws('|', customer_id, CAST(date AS VARCHAR),
                CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR))), 1, 8) AS BIGINT)) AS VARCHAR) AS content_hash
    FROM cust_events GROUP BY region"""))
def content_hash(spark, sf_dir):
    return reports.content_hash(cust_events(spark, sf_dir), ["region"])


@query("event_region_rows", "P1", sql_with(ctes("event_regions"), body="SELECT * FROM event_regions"))
def event_region_rows(spark, sf_dir):
    return event_regions(spark, sf_dir)
