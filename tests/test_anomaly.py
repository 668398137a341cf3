import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import column, day, exchanges, series
from tidemark.operators import anomaly
from tidemark.operators.anomaly import Thresholds
from tidemark.plans import customers


def customers_of(spark, many, region="r"):
    rows = [(c, region, day(i), None if v is None else float(v)) for c, vs in many.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "customer_id string, region string, date date, value double")


def flags(df, name):
    return column(df, f"{name}_flag")


def expected_flags(values, z=2.0):
    """The five masks by pandas."""
    s = pd.Series(values, dtype="float64")
    out = {}
    out["z_score"] = (np.abs((s - s.mean(skipna=False)) / s.std(ddof=0, skipna=False)) > z)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    out["iqr"] = (s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))
    filled = s.ffill()
    out["daily_change"] = filled.pct_change(fill_method=None).abs() > 0.5
    weekly = filled.pct_change(7, fill_method=None).abs() > 0.3
    out["weekly_change"] = weekly if len(s) > 7 else weekly & False
    roll = s.rolling(7)
    out["moving_average"] = np.abs(s - roll.mean()) > 2 * roll.std() + 1e-9 * np.maximum(1, roll.mean().abs())
    return {k: list(map(bool, v)) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(8))
def test_detectors_against_pandas(spark, seed):
    rnd = random.Random(seed)
    values = [round(rnd.choice([rnd.uniform(90, 110), rnd.uniform(0, 400), 0.0]), 2) for _ in range(rnd.randint(5, 40))]
    if seed % 2:
        values[rnd.randrange(len(values))] = None
    out = anomaly.detect(series(spark, values), ["k"])
    want = expected_flags(values)
    for name in anomaly.DETECTORS:
        assert flags(out, name) == want[name], name
    assert column(out, "is_anomaly") == [any(x) for x in zip(*want.values())]


def test_constant_series_flags_nothing(spark):
    out = anomaly.detect(series(spark, [0.1] * 10), ["k"])
    assert not any(column(out, "is_anomaly"))
    assert set(column(out, "z_score")) == {None}


def test_zero_steps(spark):
    out = anomaly.detect(series(spark, [0, 5, 5, 0, 0, 1]), ["k"])
    assert flags(out, "daily_change") == [False, True, False, True, False, True]


def test_a_null_silences_the_z_score_of_the_series(spark):
    two = series(spark, [1, 2, None, 50], "a").unionByName(series(spark, [1, 2, 3, 50], "b"))
    out = anomaly.with_z_score(two, ["k"])
    assert out.filter("k = 'a' and z_score is not null").count() == 0
    assert out.filter("k = 'b' and z_score is null").count() == 0


def test_seven_rows_are_evaluated_and_the_weekly_test_starts_at_eight(spark):
    seven = anomaly.customer_metrics(anomaly.detect(series(spark, [10] * 6 + [100]), ["k"]), ["k"]).first()
    assert seven.has_anomaly and seven.max_weekly_change is None
    eight = anomaly.detect(series(spark, [10] * 7 + [100]), ["k"])
    assert flags(eight, "weekly_change") == [False] * 7 + [True]


def test_metrics(spark):
    values = [10, 11, 10, 12, 10, 11, 10, 30]
    row = anomaly.customer_metrics(anomaly.detect(series(spark, values), ["k"]), ["k"]).first()
    s = pd.Series(values, dtype="float64")
    assert row.anomaly_dates[-1] == day(7) and row.anomaly_values[-1] == 30.0
    assert row.std_value == pytest.approx(s.std()) and row.mean_value == pytest.approx(s.mean())
    assert row.max_z_score == pytest.approx(np.abs((s - s.mean()) / s.std(ddof=0)).max())
    assert row.anomaly_rate == row.anomaly_count / 8 and row.last_value == 30.0 and row.last_date == day(7)


@pytest.mark.parametrize("z,severity", [(3.1, "high"), (3.0, "medium"), (2.0, "medium"), (1.9, "low"), (None, "medium")])
def test_severity(spark, z, severity):
    df = spark.createDataFrame([(z,)], "z double")
    assert df.select(anomaly.severity_of(F.col("z"))).first()[0] == severity


def test_deviation_is_zero_where_the_latest_value_is(spark):
    metrics = anomaly.customer_metrics(anomaly.detect(series(spark, [10] * 7 + [0]), ["k"]), ["k"])
    row = anomaly.alerts(metrics, "k").first()
    assert row.latest_anomaly_value == 0.0 and row.deviation_from_mean == 0.0


def test_ties_at_the_last_rank_go_to_the_smaller_key(spark):
    df = customers_of(spark, {f"c{i:02d}": [5] for i in range(25)})
    top = anomaly.top_customers(df).collect()
    assert [r.customer_id for r in top] == [f"c{i:02d}" for i in range(20)]
    assert {r.percentage for r in top} == {4.0}


def test_all_null_customer_has_total_zero(spark):
    rows = {r.customer_id: r.total_value for r in anomaly.top_customers(customers_of(spark, {"a": [None], "b": [1]})).collect()}
    assert rows == {"a": 0.0, "b": 1.0}


def test_sensitivity():
    assert [Thresholds.for_sensitivity(s).z_score for s in ("low", "medium", "high", "other")] == [3.0, 2.0, 1.5, 2.0]


def test_listing_with_free_thresholds(spark):
    df = series(spark, [1, 2, 3, 4, 5, 100, 2, 3, 4, 5])
    rows = anomaly.list_anomalies(df, ["k"], z_score=5, iqr_multiplier=1.5).collect()
    assert [(r.value, r.detectors) for r in rows] == [(100.0, ["iqr"])]


def test_real_time_alerts(spark):
    many = {"a": [9, 9, 10, 11, 10, 30], "b": [9, 9, 10, 10, 10, 30], "c": [1, 2, 3, 4, 5, 5]}
    rows = anomaly.real_time_alerts(customers_of(spark, many)).collect()
    assert [r.customer_id for r in rows] == ["a"]
    history = pd.Series([10, 11, 10], dtype="float64")
    assert rows[0].z_score == pytest.approx((30 - history.mean()) / history.std())
    assert rows[0].expected_range == f"{history.mean():.2f} ± {2 * history.std():.2f}"


def test_report_and_export(spark, tmp_path):
    rnd = random.Random(42)
    many = {f"c{i}": [rnd.uniform(90, 110) * (3 if rnd.random() < 0.05 else 1) for _ in range(30)] for i in range(25)}
    raw = customers_of(spark, many)
    raw = raw.unionByName(raw)  # copies do not count twice
    report = customers.analyse(raw)
    summary = report.summary.first()
    assert (summary.total_customers, summary.top_customers_analyzed) == (25, 20)
    assert summary.customers_with_anomalies == report.alerts.count()
    order = {"high": 0, "medium": 1, "low": 2}
    got = [order[r.severity] for r in report.alerts.collect()]
    assert got == sorted(got)
    assert report.regions.first().total_customers == 25
    assert customers.export(report, str(tmp_path)) == ["summary", "top_customers", "regions", "alerts"]
    assert spark.read.option("header", True).csv(str(tmp_path / "alerts")).count() == report.alerts.count()


def test_no_alerts_part_without_alerts(spark, tmp_path):
    report = anomaly.analyse_customers(customers_of(spark, {"a": [5.0] * 10}))
    assert "alerts" not in customers.export(report, str(tmp_path))


def test_rows_of_one_day_have_a_fixed_order(spark):
    rows = [("a", r, day(i), float(10 + i + (5 if r == "s" else 0))) for i in range(8) for r in ("r", "s")]
    one = spark.createDataFrame(rows, "customer_id string, region string, date date, value double")
    other = spark.createDataFrame(rows[::-1], one.schema).repartition(3)
    a, b = (anomaly.analyse_customers(x).details.first() for x in (one, other))
    assert a == b


def test_detection_shares_one_shuffle(spark):
    df = anomaly.customer_metrics(anomaly.detect(series(spark, range(20)), ["k"]), ["k"])
    df.write.format("noop").mode("overwrite").save()
    assert exchanges(df) == 1
