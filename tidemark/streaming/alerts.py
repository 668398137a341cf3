"""Real-time customer alerts on a stream of readings, as sliding windows of column expressions.

A window holds one day and the days before it that the day is judged by, one total for each, so the state of a customer
is a few numbers for each day that late rows may still reach. Rows are added up before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.anomaly import ROUNDING, Thresholds
from ..schema import utc_instant

DAY_S = 86_400


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def daily_verdicts(
    stream: DataFrame, customer: str = "customer_id", ts: str = "ts", value: str = "value",
    limits: Thresholds = Thresholds(), days: int = 3, lateness: str = "3 days",
) -> DataFrame:
    """For each customer and UTC day with rows: the total, and whether it is out of the range of the ``days`` before.

    Run it in update mode: a day's verdict comes again whenever rows change it or a day that it is judged by, and the
    last one holds. It also comes when a day is no longer unusual. Rows later than ``lateness`` are left out.
    """
    rows = stream.filter(F.col(customer).isNotNull()).select(
        F.col(customer).cast("string").alias("customer_id"), utc_instant(stream, ts).alias("ts"),
        F.col(value).cast("double").alias("value"),
    ).withWatermark("ts", lateness).withColumn("span", F.window("ts", f"{days + 1} days", "1 day"))
    # how many days before the window's last one a row is
    age = days - F.floor((F.unix_seconds("ts") - F.unix_seconds("span.start")) / DAY_S)
    totals = [F.sum(F.when(age == k, F.coalesce("value", F.lit(0.0)))).alias(f"_d{k}") for k in range(days + 1)]
    found = rows.groupBy("customer_id", "span").agg(*totals).filter(F.col("_d0").isNotNull())
    earlier = [F.col(f"_d{k}") for k in range(1, days + 1)]
    n = _sum([c.isNotNull().cast("int") for c in earlier])
    found = found.withColumn("_n", n).withColumn("_mean", _sum([F.coalesce(c, F.lit(0.0)) for c in earlier]) / F.nullif("_n", F.lit(0)))
    squares = _sum([F.coalesce((c - F.col("_mean")) ** 2, F.lit(0.0)) for c in earlier])
    found = found.withColumn("_std", F.when(F.col("_n") > 1, F.sqrt(squares / (F.col("_n") - 1))))
    judged = F.col("_std") > ROUNDING * F.greatest(F.lit(1.0), F.abs("_mean"))
    z = F.when(judged, F.abs(F.col("_d0") - F.col("_mean")) / F.col("_std"))
    return found.select(
        "customer_id", F.lit("real_time").alias("alert_type"),
        F.date_from_unix_date((F.unix_seconds("span.end") / DAY_S).cast("int") - 1).alias("date"), F.col("_d0").alias("latest_value"),
        F.when(judged, F.format_string("%.2f ± %.2f", "_mean", 2 * F.col("_std"))).alias("expected_range"), z.alias("z_score"),
        F.coalesce(z > limits.z_score, F.lit(False)).alias("is_alert"),
    )


def current_alerts(verdicts: DataFrame) -> DataFrame:
    """The alerts that hold: of the verdicts as ``run.run_updates`` stores them, each customer's latest day, last word.

    Verdicts of a customer and day collapse before the shuffle.
    """
    columns = [c for c in verdicts.columns if c not in ("customer_id", "date", "batch")]
    last = verdicts.groupBy("customer_id", "date").agg(F.max_by(F.struct(*columns), "batch").alias("verdict"))
    newest = F.max("date").over(W.partitionBy("customer_id"))
    held = last.withColumn("_newest", newest).filter((F.col("date") == F.col("_newest")) & F.col("verdict.is_alert"))
    return held.select("customer_id", "date", "verdict.*").drop("is_alert")
