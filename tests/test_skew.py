"""One key with far more rows than the others: results stay whole, and no task gets the raw rows."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan_text
from tidemark.operators import anomaly, clean, reports, climate
from tidemark.plans import customers, ingest

DAYS, HOT = 40, 20_000


@pytest.fixture(scope="module")
def raw(spark):
    """Customer "hot" has many rows a day, 30 others have one a day."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % DAYS).cast("int"))
    hot = spark.range(0, HOT, 1, 4).select(
        F.lit("hot").alias("customer_id"), F.lit("r").alias("region"), day.alias("date"),
        (F.col("id") % 97 + 1).cast("double").alias("value"), "id",
    )
    others = spark.range(0, 30 * DAYS, 1, 4).select(
        F.concat(F.lit("c"), F.floor(F.col("id") / DAYS)).alias("customer_id"), F.lit("s").alias("region"),
        day.alias("date"), (F.col("id") % 13 + 1).cast("double").alias("value"), F.col("id"),
    )
    return hot.unionByName(others)  # 8 partitions


def _shuffled_rows(df):
    """Rows written by each shuffle of the executed plan."""
    df.collect()
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    assert out
    return out


def test_daily_totals_bound_what_is_shuffled_by_key(raw):
    daily = clean.daily_series(raw, ["customer_id", "region"])
    assert daily.filter("customer_id = 'hot'").count() == DAYS
    assert max(_shuffled_rows(anomaly.detect(daily, ["customer_id"]))) <= 31 * DAYS * 8


def test_copies_of_one_key_collapse_before_the_shuffle(raw):
    kept = clean.keep_first(raw, ["customer_id", "date", "region"], "id")
    assert kept.count() == 31 * DAYS
    assert max(_shuffled_rows(kept)) <= 31 * DAYS * 8


def test_analysis_of_raw_rows_is_that_of_the_kept_ones(raw):
    kept = ingest.import_customers(raw, sequence="id").rows
    a = customers.analyse(raw, sequence="id").alerts.collect()
    assert sorted(a) == sorted(anomaly.analyse_customers(kept).alerts.collect()) and a


def test_regional_distinct_count_is_spread(raw):
    df = reports.customer_summary_by_region(raw)
    assert {r.region: r.customers for r in df.collect()} == {"r": 1, "s": 30}
    assert max(_shuffled_rows(df)) <= 31 * 8


def test_duplicates_of_a_hot_row(raw):
    rows = raw.select(F.when(F.col("customer_id") == "hot", "hot").otherwise(F.col("customer_id")).alias("c"))
    out = reports.count_duplicates(rows)
    assert out.first().duplicate_rows == HOT + 30 * DAYS - 31
    assert max(_shuffled_rows(out)) <= 31 * 8


def test_hot_city_rolls_up_map_side(raw):
    readings = raw.select(
        F.col("customer_id").alias("city"), "date", F.col("value").alias("temperature"), F.col("value").alias("humidity"),
        F.col("value").alias("pressure"), F.col("value").alias("wind_speed"), F.col("value").alias("precipitation"),
        F.lit("Rain").alias("weather_main"), F.lit("api").alias("data_source"),
    )
    out = climate.daily_forecast(readings)
    assert max(_shuffled_rows(out)) <= 31 * DAYS * 8
    assert out.count() == 31 * DAYS


def test_no_window_without_a_key(raw):
    report = anomaly.analyse_customers(clean.daily_series(raw, ["customer_id", "region"]))
    for part in (report.summary, report.top_customers, report.details, report.alerts):
        text = plan_text(part)
        specs = text.count("windowspecdefinition(")
        assert "CartesianProduct" not in text and specs == text.count("windowspecdefinition(customer_id")
