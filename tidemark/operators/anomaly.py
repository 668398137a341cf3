"""Customer ranking, anomaly detectors, alerts and the report made of them.

The detectors work on canonical daily rows (see ``clean``): windows are partitioned by
customer, whose rows the calendar bounds. Totals and summaries are partial aggregates.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import half_up, percent_of, ratio
from .clean import recent, with_min_history

# Z-score threshold of each sensitivity.
SENSITIVITY = {"low": 3.0, "medium": 2.0, "high": 1.5}

DETECTORS = ("z_score", "iqr", "daily_change", "weekly_change", "moving_average")
SEVERITIES = ("high", "medium", "low")

# A rolling mean of equal values may differ from them in the last digit while the rolling
# deviation is exactly 0; differences below this share of the mean do not count.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Thresholds:
    """What counts as unusual."""

    z_score: float = 2.0
    iqr_multiplier: float = 1.5
    daily_change: float = 0.5
    weekly_change: float = 0.3
    moving_average: float = 2.0
    min_history: int = 7
    top_customers: int = 20

    @classmethod
    def for_sensitivity(cls, level: str = "medium", **others) -> "Thresholds":
        """An unknown level counts as medium."""
        return replace(cls(**others), z_score=SENSITIVITY.get(level, SENSITIVITY["medium"]))


@dataclass(frozen=True)
class AnomalyReport:
    """The parts of a customer analysis; each is lazy."""

    summary: DataFrame
    top_customers: DataFrame
    details: DataFrame
    regions: DataFrame
    alerts: DataFrame
    rows: DataFrame


def top_customers(
    df: DataFrame, customer: str = "customer_id", value: str = "value", n: int = 20,
) -> DataFrame:
    """The n customers with the highest totals and their share of the total of all customers."""
    totals = df.filter(F.col(customer).isNotNull()).groupBy(customer).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total_value")
    )
    everything = totals.agg(F.sum("total_value").alias("everything")).scalar()
    return (
        totals.orderBy(F.col("total_value").desc(), customer).limit(n)
        .withColumn("percentage", percent_of(F.col("total_value"), everything))
    )


def rows_of_top(df: DataFrame, top: DataFrame, customer: str = "customer_id") -> DataFrame:
    """The rows of the ranked customers; a short ranking is broadcast, as Spark sees its size."""
    return df.join(top.select(customer), customer, "left_semi")


def with_z_score(df: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Distance from the mean in population deviations.

    Null for the whole series if it is constant or holds a null.
    """
    series = W.partitionBy(*key)
    complete = F.count(value).over(series) == F.count("*").over(series)
    spread = F.stddev_pop(value).over(series)
    distance = F.abs(F.col(value) - F.avg(value).over(series))
    return df.withColumn("z_score", F.when(complete, ratio(distance, spread)))


def with_fences(df: DataFrame, key: Sequence[str], value: str = "value", multiplier: float = 1.5) -> DataFrame:
    """Quartile fences of each series, with linearly interpolated quartiles."""
    quartiles = F.percentile(value, [0.25, 0.75]).over(W.partitionBy(*key))
    out = df.withColumn("_q", quartiles)
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return out.withColumns({
        "lower_fence": q1 - (q3 - q1) * multiplier,
        "upper_fence": q3 + (q3 - q1) * multiplier,
    }).drop("_q")


def _relative_change(now: Column, before: Column) -> Column:
    """Against the earlier value; from 0 to another value is infinite, from 0 to 0 is none."""
    return (
        F.when((before == 0) & (now != 0), F.lit(float("inf")))
        .otherwise(F.abs(ratio(now, before) - 1))
    )


def with_changes(
    df: DataFrame, key: Sequence[str], value: str = "value", date: str = "date", ties: Sequence[str] = (),
) -> DataFrame:
    """Absolute relative change against the row 1 and 7 rows earlier, nulls carried forward first.

    By row position: a missing day is not made up for. ``ties`` orders rows of one date.
    """
    periods = {"daily_change": 1, "weekly_change": 7}
    order = W.partitionBy(*key).orderBy(date, *ties)
    carried = F.last(value, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    out = df.withColumn("_carried", carried)
    out = out.withColumns({f"_before_{c}": F.lag("_carried", n).over(order) for c, n in periods.items()})
    out = out.withColumns({c: _relative_change(F.col("_carried"), F.col(f"_before_{c}")) for c in periods})
    return out.drop("_carried", *[f"_before_{c}" for c in periods])


def with_moving_average(
    df: DataFrame, key: Sequence[str], value: str = "value", date: str = "date", ties: Sequence[str] = (),
    window: int = 7,
) -> DataFrame:
    frame = W.partitionBy(*key).orderBy(date, *ties).rowsBetween(1 - window, 0)
    full = F.count(value).over(frame) == window
    return df.withColumns({
        "moving_mean": F.when(full, F.avg(value).over(frame)),
        "moving_std": F.when(full, F.stddev_samp(value).over(frame)),
    })


def detect(
    df: DataFrame, key: Sequence[str] = ("customer_id",), value: str = "value", date: str = "date",
    limits: Thresholds = Thresholds(), ties: Sequence[str] = (),
) -> DataFrame:
    """All rows with the five detector flags, their disjunction and the names of those that fired.

    A series of exactly 7 rows is evaluated like any other; its weekly test does not fire.
    """
    out = with_changes(df, key, value, date, ties)
    out = with_moving_average(out, key, value, date, ties)
    out = with_z_score(out, key, value)
    out = with_fences(out, key, value, limits.iqr_multiplier)
    v = F.col(value)
    slack = ROUNDING * F.greatest(F.lit(1.0), F.abs("moving_mean"))
    flags = {
        "z_score": F.col("z_score") > limits.z_score,
        "iqr": (v < F.col("lower_fence")) | (v > F.col("upper_fence")),
        "daily_change": F.col("daily_change") > limits.daily_change,
        "weekly_change": F.col("weekly_change") > limits.weekly_change,
        "moving_average": F.abs(v - F.col("moving_mean")) > limits.moving_average * F.col("moving_std") + slack,
    }
    out = out.withColumns({f"{name}_flag": F.coalesce(flag, F.lit(False)) for name, flag in flags.items()})
    fired = F.array_compact(F.array(*[F.when(F.col(f"{d}_flag"), F.lit(d)) for d in DETECTORS]))
    return out.withColumn("detectors", fired).withColumn("is_anomaly", F.size("detectors") > 0)


def list_anomalies(
    df: DataFrame, key: Sequence[str], value: str = "value", z_score: float = 2.0, iqr_multiplier: float = 1.5,
) -> DataFrame:
    """The rows of any series that lie too far out by z-score or by quartile fences."""
    out = with_fences(with_z_score(df, key, value), key, value, iqr_multiplier)
    by_z = F.coalesce(F.col("z_score") > z_score, F.lit(False))
    by_iqr = F.coalesce((F.col(value) < F.col("lower_fence")) | (F.col(value) > F.col("upper_fence")), F.lit(False))
    names = F.array_compact(F.array(F.when(by_z, F.lit("z_score")), F.when(by_iqr, F.lit("iqr"))))
    return out.withColumn("detectors", names).filter(F.size("detectors") > 0)


def customer_metrics(
    detected: DataFrame, key: Sequence[str] = ("customer_id",), value: str = "value", date: str = "date",
    ties: Sequence[str] = (), carry: Sequence[str] = (),
) -> DataFrame:
    """One row per series from the output of :func:`detect`; grouped by the key its windows used.

    ``carry`` names columns that are constant within a series and are kept.
    """
    hit = F.col("is_anomaly")
    entry = F.struct(F.col(date).alias("date"), *ties, F.col(value).alias("value"))
    found = F.array_sort(F.collect_list(F.when(hit, entry)))
    last = F.struct(date, *ties) if ties else F.col(date)
    out = detected.groupBy(*key).agg(
        F.count("*").alias("n_rows"),
        F.count_if(hit).alias("anomaly_count"),
        found.alias("_found"),
        F.avg(value).alias("mean_value"),
        F.stddev_samp(value).alias("std_value"),
        F.max("z_score").alias("max_z_score"),
        F.max("daily_change").alias("max_daily_change"),
        F.max("weekly_change").alias("max_weekly_change"),
        F.max_by(value, last).alias("last_value"),
        F.max(date).alias("last_date"),
        *[F.max(c).alias(c) for c in carry],
    )
    return (
        out.withColumn("has_anomaly", F.col("anomaly_count") > 0)
        .withColumn("anomaly_rate", F.col("anomaly_count") / F.col("n_rows"))
        .withColumn("anomaly_dates", F.col("_found.date"))
        .withColumn("anomaly_values", F.col("_found.value"))
        .drop("_found")
    )


def severity_of(max_z: Column) -> Column:
    """high above 3, low below 2, else medium; medium too where there is no z-score."""
    return F.when(max_z > 3, "high").when(max_z < 2, "low").otherwise("medium")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def alerts(metrics: DataFrame, customer: str = "customer_id", carry: Sequence[str] = ()) -> DataFrame:
    """One alert per customer with anomalies."""
    latest_value = F.try_element_at("anomaly_values", F.lit(-1))
    deviation = F.when(
        F.coalesce(latest_value, F.lit(0.0)) != 0, F.abs(latest_value - F.col("mean_value"))
    ).otherwise(0.0)
    return metrics.filter("has_anomaly").select(
        customer,
        severity_of(F.col("max_z_score")).alias("severity"),
        "anomaly_count",
        F.try_element_at("anomaly_dates", F.lit(-1)).alias("latest_anomaly_date"),
        latest_value.alias("latest_anomaly_value"),
        deviation.alias("deviation_from_mean"),
        F.col("max_z_score").alias("z_score"),
        *carry,
    )


def by_severity(alert_rows: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Alerts in display order: severity, then total of the customer."""
    return alert_rows.orderBy(severity_rank(F.col("severity")), F.col("total_value").desc(), customer)


def regional_summary(
    df: DataFrame, region: str = "region", value: str = "value", customer: str = "customer_id",
) -> DataFrame:
    return df.filter(F.col(region).isNotNull()).groupBy(region).agg(
        F.countDistinct(customer).alias("total_customers"),
        F.sum(value).alias("total_value"),
        F.avg(value).alias("avg_value"),
        F.max(value).alias("max_value"),
        F.min(value).alias("min_value"),
    )


def report_summary(
    df: DataFrame, metrics: DataFrame, limits: Thresholds = Thresholds(), analysed_at: dt.datetime | None = None,
    customer: str = "customer_id",
) -> DataFrame:
    """One row of totals over the analysis."""
    when = F.current_timestamp() if analysed_at is None else F.lit(analysed_at)
    customers = df.agg(F.countDistinct(customer).alias("n")).scalar()
    return metrics.agg(
        F.count_if("has_anomaly").alias("customers_with_anomalies"),
        F.coalesce(F.sum("anomaly_count"), F.lit(0)).alias("total_anomalies"),
    ).select(
        customers.alias("total_customers"),
        F.least(customers, F.lit(limits.top_customers)).cast("bigint").alias("top_customers_analyzed"),
        "customers_with_anomalies", "total_anomalies",
        F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("analysis_date"),
    )


def analyse_customers(
    df: DataFrame, customer: str = "customer_id", date: str = "date", value: str = "value",
    region: str = "region", limits: Thresholds = Thresholds(), analysed_at: dt.datetime | None = None,
) -> AnomalyReport:
    """The whole customer analysis over canonical customer rows.

    The ranked totals travel with the rows of the ranked customers, so the ranking is
    computed once for the alerts and their order.
    """
    top = top_customers(df, customer, value, limits.top_customers)
    ranked = F.broadcast(top.select(customer, "total_value"))  # at most top_customers rows
    # counted after the detectors, whose sort the count can use
    detected = detect(df.join(ranked, customer), [customer], value, date, limits, [region])
    detected = with_min_history(detected, [customer], limits.min_history)
    metrics = customer_metrics(detected, [customer], value, date, [region], ["total_value"])
    return AnomalyReport(
        summary=report_summary(df, metrics, limits, analysed_at, customer),
        top_customers=top,
        details=metrics,
        regions=regional_summary(df, region, value, customer),
        alerts=by_severity(alerts(metrics, customer, ["total_value"]), customer),
        rows=detected,
    )


def real_time_alerts(
    df: DataFrame, customer: str = "customer_id", date: str = "date", value: str = "value",
    limits: Thresholds = Thresholds(), days: int = 3, alert_time: dt.datetime | None = None,
    per_customer_clock: bool = False, ties: Sequence[str] = (),
) -> DataFrame:
    """The latest value of each customer against the earlier ones of the last days.

    The window ends at the latest date of all rows, or of each customer. Needs two earlier
    values that differ.
    """
    rows = recent(df.filter(F.col(customer).isNotNull()), days, date, [customer] if per_customer_clock else ())
    order = W.partitionBy(customer).orderBy(date, *ties)
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    scored = (
        rows.withColumn("_mean", F.avg(value).over(earlier))
        .withColumn("_std", F.stddev_samp(value).over(earlier))
        .withColumn("_next", F.lead(date).over(order))
        .filter(F.col("_next").isNull())
    )
    when = F.current_timestamp() if alert_time is None else F.lit(alert_time)
    real = F.col("_std") > ROUNDING * F.greatest(F.lit(1.0), F.abs("_mean"))
    return (
        scored.filter(real)
        .withColumn("z_score", F.abs(F.col(value) - F.col("_mean")) / F.col("_std"))
        .filter(F.col("z_score") > limits.z_score)
        .select(
            customer, F.lit("real_time").alias("alert_type"), F.col(value).alias("latest_value"),
            F.format_string("%.2f ± %.2f", half_up(F.col("_mean"), 2), half_up(2 * F.col("_std"), 2)).alias("expected_range"),
            "z_score", F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("alert_time"),
        )
    )
