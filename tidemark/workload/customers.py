"""Customer ranking, anomaly detection and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, clean
from ..operators.anomaly import SENSITIVITY, Thresholds
from .inputs import KEY, ctes, cust_events, cust_orders, nulled, region_daily
from .registry import query, rounded, sql_with

TOP = """top AS (
    SELECT customer_id, total_value,
           ROUND(total_value / (SELECT SUM(value) FROM {src}) * 100, 2) AS percentage
    FROM (SELECT customer_id, COALESCE(SUM(value), 0) AS total_value FROM {src} GROUP BY customer_id)
    ORDER BY total_value DESC, customer_id LIMIT 20)"""

HISTORY = """candidates AS (
    SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY customer_id) AS n_hist FROM {src} {where})
    WHERE n_hist >= 7)"""


def detect_sql(src: str, key: str = "customer_id", z: float = 2.0, iqr: float = 1.5) -> str:
    """CTEs from ``src`` to ``detected``."""
    return f"""carried_rows AS (
    SELECT *, LAST_VALUE(value IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM {src}),
stat_rows AS (
    SELECT *, LAG(carried, 1) OVER o AS b1, LAG(carried, 7) OVER o AS b7,
           CASE WHEN COUNT(value) OVER f = 7 THEN AVG(value) OVER f END AS moving_mean,
           CASE WHEN COUNT(value) OVER f = 7 THEN STDDEV_SAMP(value) OVER f END AS moving_std,
           CASE WHEN COUNT(value) OVER s = COUNT(*) OVER s THEN AVG(value) OVER s END AS mu,
           STDDEV_POP(value) OVER s AS sigma,
           QUANTILE_CONT(value, 0.25) OVER s AS q1, QUANTILE_CONT(value, 0.75) OVER s AS q3
    FROM carried_rows
    WINDOW s AS (PARTITION BY {key}), o AS (PARTITION BY {key} ORDER BY date),
           f AS (PARTITION BY {key} ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
measure_rows AS (
    SELECT *, CASE WHEN sigma > 0 THEN ABS(value - mu) / sigma END AS z_score,
           q1 - {iqr} * (q3 - q1) AS lower_fence, q3 + {iqr} * (q3 - q1) AS upper_fence,
           CASE WHEN b1 = 0 AND carried <> 0 THEN CAST('Infinity' AS DOUBLE)
                WHEN b1 <> 0 THEN ABS(carried / b1 - 1) END AS daily_change,
           CASE WHEN b7 = 0 AND carried <> 0 THEN CAST('Infinity' AS DOUBLE)
                WHEN b7 <> 0 THEN ABS(carried / b7 - 1) END AS weekly_change
    FROM stat_rows),
flag_rows AS (
    SELECT *, COALESCE(z_score > {z}, FALSE) AS z_score_flag,
           COALESCE(value < lower_fence OR value > upper_fence, FALSE) AS iqr_flag,
           COALESCE(daily_change > 0.5, FALSE) AS daily_change_flag,
           COALESCE(weekly_change > 0.3, FALSE) AS weekly_change_flag,
           COALESCE(ABS(value - moving_mean) > 2 * moving_std + 1e-9 * GREATEST(1, ABS(moving_mean)), FALSE)
               AS moving_average_flag
    FROM measure_rows),
detected AS (
    SELECT *, z_score_flag OR iqr_flag OR daily_change_flag OR weekly_change_flag OR moving_average_flag AS is_anomaly
    FROM flag_rows)"""


METRICS = """metrics AS (
    SELECT customer_id, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE is_anomaly) AS anomaly_count,
           MAX(z_score) AS max_z_score, MAX(daily_change) AS max_daily_change,
           MAX(weekly_change) AS max_weekly_change, AVG(value) AS mean_value, STDDEV_SAMP(value) AS std_value,
           ARG_MAX(value, date) AS last_value, MAX(date) AS last_date,
           STRING_AGG(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (WHERE is_anomaly) AS anomaly_dates,
           STRING_AGG(printf('%.2f', value), ',' ORDER BY date) FILTER (WHERE is_anomaly) AS anomaly_values,
           MAX(date) FILTER (WHERE is_anomaly) AS latest_anomaly_date,
           ARG_MAX(value, date) FILTER (WHERE is_anomaly) AS latest_anomaly_value
    FROM detected GROUP BY customer_id)"""


def analysis_sql(src: str) -> str:
    where = "WHERE customer_id IN (SELECT customer_id FROM top)"
    return ",\n".join([ctes(src), TOP.format(src=src), HISTORY.format(src=src, where=where),
                       detect_sql("candidates"), METRICS])


ALERTS_BODY = """
    SELECT customer_id, CASE WHEN max_z_score > 3 THEN 'high' WHEN max_z_score < 2 THEN 'low' ELSE 'medium' END AS severity,
           anomaly_count, latest_anomaly_date, latest_anomaly_value,
           ROUND(CASE WHEN COALESCE(latest_anomaly_value, 0) <> 0 THEN ABS(latest_anomaly_value - mean_value) ELSE 0 END, 4)
               AS deviation_from_mean,
           ROUND(max_z_score, 4) AS z_score
    FROM metrics WHERE anomaly_count > 0"""


def _alerts(df):
    return rounded(anomaly.analyse_customers(df).alerts.drop("total_value"), 4, "deviation_from_mean", "z_score")


@query("customer_alerts", "AL1 AL2 S7", sql_with(analysis_sql("cust_events"), body=ALERTS_BODY))
def customer_alerts(spark, sf_dir):
    return _alerts(cust_events(spark, sf_dir))


@query("customer_alerts_orders", "AL1 AL2 S7", sql_with(analysis_sql("cust_orders"), body=ALERTS_BODY))
def customer_alerts_orders(spark, sf_dir):
    return _alerts(cust_orders(spark, sf_dir))


@query("top_customers", "A1 M1", sql_with(
    ctes("cust_orders"), TOP.format(src="cust_orders"),
    body="SELECT customer_id, ROUND(total_value, 2) AS total_value, percentage FROM top"))
def top_customers(spark, sf_dir):
    return rounded(anomaly.top_customers(cust_orders(spark, sf_dir)), 2, "total_value")


@query("rows_of_top_customers", "J7", sql_with(
    ctes("cust_orders"), TOP.format(src="cust_orders"),
    body="SELECT customer_id, region, date, value FROM cust_orders WHERE customer_id IN (SELECT customer_id FROM top)"))
def rows_of_top_customers(spark, sf_dir):
    df = cust_orders(spark, sf_dir)
    return anomaly.rows_of_top(df, anomaly.top_customers(df)).select("customer_id", "region", "date", "value")


@query("regional_summary", "A2", sql_with(ctes("cust_orders"), body="""
    SELECT region, COUNT(DISTINCT customer_id) AS total_customers, ROUND(SUM(value), 2) AS total_value,
           ROUND(AVG(value), 2) AS avg_value, MAX(value) AS max_value, MIN(value) AS min_value
    FROM cust_orders GROUP BY region"""))
def regional_summary(spark, sf_dir):
    return rounded(anomaly.regional_summary(cust_orders(spark, sf_dir)), 2, "total_value", "avg_value")


@query("customer_anomaly_metrics", "A3 AL2", sql_with(
    ctes("cust_orders"), HISTORY.format(src="cust_orders", where=""), detect_sql("candidates"), METRICS, body="""
    SELECT customer_id, n_rows, anomaly_count, anomaly_count > 0 AS has_anomaly,
           ROUND(CAST(anomaly_count AS DOUBLE) / n_rows, 6) AS anomaly_rate, ROUND(max_z_score, 4) AS max_z_score,
           ROUND(max_daily_change, 4) AS max_daily_change, ROUND(max_weekly_change, 4) AS max_weekly_change,
           ROUND(mean_value, 4) AS mean_value, ROUND(std_value, 4) AS std_value, last_value, last_date,
           COALESCE(anomaly_dates, '') AS anomaly_dates, COALESCE(anomaly_values, '') AS anomaly_values
    FROM metrics"""))
def customer_anomaly_metrics(spark, sf_dir):
    rows = clean.with_min_history(anomaly.detect(cust_orders(spark, sf_dir), KEY), KEY)
    out = anomaly.customer_metrics(rows)
    out = rounded(out, 4, "max_z_score", "max_daily_change", "max_weekly_change", "mean_value", "std_value")
    texts = F.transform("anomaly_values", lambda v: F.format_string("%.2f", v))
    return rounded(out, 6, "anomaly_rate").withColumns({
        "anomaly_dates": F.array_join(F.transform("anomaly_dates", lambda d: d.cast("string")), ","),
        "anomaly_values": F.array_join(texts, ","),
    })


@query("anomaly_report_summary", "A4", sql_with(analysis_sql("cust_events"), body="""
    SELECT (SELECT COUNT(DISTINCT customer_id) FROM cust_events) AS total_customers,
           (SELECT COUNT(*) FROM top) AS top_customers_analyzed,
           COUNT(*) FILTER (WHERE anomaly_count > 0) AS customers_with_anomalies,
           CAST(SUM(anomaly_count) AS BIGINT) AS total_anomalies
    FROM metrics"""))
def anomaly_report_summary(spark, sf_dir):
    return anomaly.analyse_customers(cust_events(spark, sf_dir)).summary.drop("analysis_date")


@query("min_history_rows", "P6", sql_with(
    ctes("cust_orders"), HISTORY.format(src="cust_orders", where=""),
    body="SELECT customer_id, region, date, value FROM candidates"))
def min_history_rows(spark, sf_dir):
    return clean.with_min_history(cust_orders(spark, sf_dir), KEY)


@query("z_score_rows", "W6", sql_with(ctes("cust_events"), detect_sql("cust_events"), body="""
    SELECT customer_id, date, value, ROUND(z_score, 4) AS z_score FROM detected"""))
def z_score_rows(spark, sf_dir):
    out = anomaly.with_z_score(cust_events(spark, sf_dir), KEY)
    return rounded(out, 4, "z_score").select("customer_id", "date", "value", "z_score")


@query("z_score_rows_with_nulls", "W6", sql_with(ctes("nulled"), detect_sql("nulled"), body="""
    SELECT customer_id, date, value, ROUND(z_score, 4) AS z_score FROM detected"""))
def z_score_rows_with_nulls(spark, sf_dir):
    out = anomaly.with_z_score(nulled(spark, sf_dir), KEY)
    return rounded(out, 4, "z_score").select("customer_id", "date", "value", "z_score")


@query("iqr_fences", "W7", sql_with(ctes("cust_orders"), detect_sql("cust_orders", iqr=3.0), body="""
    SELECT customer_id, date, value, ROUND(lower_fence, 4) AS lower_fence, ROUND(upper_fence, 4) AS upper_fence
    FROM detected"""))
def iqr_fences(spark, sf_dir):
    out = anomaly.with_fences(cust_orders(spark, sf_dir), KEY, multiplier=3.0)
    return rounded(out, 4, "lower_fence", "upper_fence").drop("region")


@query("relative_changes", "W8 W9", sql_with(ctes("nulled"), detect_sql("nulled"), body="""
    SELECT customer_id, date, value, ROUND(daily_change, 8) AS daily_change, ROUND(weekly_change, 8) AS weekly_change
    FROM detected"""))
def relative_changes(spark, sf_dir):
    out = anomaly.with_changes(nulled(spark, sf_dir), KEY)
    return rounded(out, 8, "daily_change", "weekly_change").drop("region")


@query("moving_average", "W10", sql_with(ctes("cust_events"), detect_sql("cust_events"), body="""
    SELECT customer_id, date, ROUND(moving_mean, 4) AS moving_mean, ROUND(moving_std, 4) AS moving_std,
           moving_average_flag FROM detected"""))
def moving_average(spark, sf_dir):
    out = anomaly.detect(cust_events(spark, sf_dir), KEY)
    return rounded(out, 4, "moving_mean", "moving_std").select(
        "customer_id", "date", "moving_mean", "moving_std", "moving_average_flag"
    )


@query("detected_rows", "W6 W7 W8 W9 W10 W11", sql_with(
    ctes("cust_orders"), HISTORY.format(src="cust_orders", where=""), detect_sql("candidates"), body="""
    SELECT customer_id, date, value, z_score_flag, iqr_flag, daily_change_flag, weekly_change_flag,
           moving_average_flag, is_anomaly,
           concat_ws(',', CASE WHEN z_score_flag THEN 'z_score' END, CASE WHEN iqr_flag THEN 'iqr' END,
                     CASE WHEN daily_change_flag THEN 'daily_change' END,
                     CASE WHEN weekly_change_flag THEN 'weekly_change' END,
                     CASE WHEN moving_average_flag THEN 'moving_average' END) AS detectors
    FROM detected"""))
def detected_rows(spark, sf_dir):
    out = clean.with_min_history(anomaly.detect(cust_orders(spark, sf_dir), KEY), KEY)
    return out.select(
        "customer_id", "date", "value", *[f"{d}_flag" for d in anomaly.DETECTORS], "is_anomaly",
        F.array_join("detectors", ",").alias("detectors"),
    )


@query("sensitivity_levels", "AL3", sql_with(ctes("cust_events"), detect_sql("cust_events"), body="""
    SELECT level, customer_id, COUNT(*) FILTER (WHERE z_score > threshold) AS n_flagged
    FROM detected CROSS JOIN (VALUES ('low', 3.0), ('medium', 2.0), ('high', 1.5)) AS levels(level, threshold)
    GROUP BY level, customer_id"""))
def sensitivity_levels(spark, sf_dir):
    scored = anomaly.with_z_score(cust_events(spark, sf_dir), KEY)
    counts = scored.groupBy("customer_id").agg(*[
        F.count_if(F.col("z_score") > Thresholds.for_sensitivity(level).z_score).alias(level) for level in SENSITIVITY
    ])
    return counts.select("customer_id", F.inline(F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(level).alias("n_flagged")) for level in SENSITIVITY
    ])))


@query("anomaly_listing", "AL4", sql_with(ctes("region_daily"), detect_sql("region_daily", "region", 2.5, 2.0), body="""
    SELECT region, date, value, ROUND(z_score, 4) AS z_score,
           concat_ws(',', CASE WHEN z_score_flag THEN 'z_score' END, CASE WHEN iqr_flag THEN 'iqr' END) AS detectors
    FROM detected WHERE z_score_flag OR iqr_flag"""))
def anomaly_listing(spark, sf_dir):
    out = anomaly.list_anomalies(region_daily(spark, sf_dir), ["region"], z_score=2.5, iqr_multiplier=2.0)
    return rounded(out, 4, "z_score").select(
        "region", "date", "value", "z_score", F.array_join("detectors", ",").alias("detectors")
    )


REAL_TIME = """recent AS (
    SELECT * FROM cust_events WHERE date >= (SELECT MAX(date) FROM cust_events) - INTERVAL 3 DAY),
history AS (
    SELECT *, AVG(value) OVER e AS mu, STDDEV_SAMP(value) OVER e AS sd,
           LEAD(date) OVER (PARTITION BY customer_id ORDER BY date) AS next_date
    FROM recent
    WINDOW e AS (PARTITION BY customer_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("real_time_alerts", "W12 ST1 P7", sql_with(ctes("cust_events"), REAL_TIME, body="""
    SELECT customer_id, 'real_time' AS alert_type, value AS latest_value,
           printf('%.2f ± %.2f', ROUND(mu, 2), ROUND(2 * sd, 2)) AS expected_range, ROUND(ABS(value - mu) / sd, 4) AS z_score
    FROM history WHERE next_date IS NULL AND sd > 1e-9 * GREATEST(1, ABS(mu)) AND ABS(value - mu) / sd > 2"""))
def real_time_alerts(spark, sf_dir):
    return rounded(anomaly.real_time_alerts(cust_events(spark, sf_dir)), 4, "z_score").drop("alert_time")


@query("recent_rows", "P7", sql_with(ctes("cust_events"), REAL_TIME, body="SELECT customer_id, region, date, value FROM recent"))
def recent_rows(spark, sf_dir):
    return clean.recent(cust_events(spark, sf_dir))
