import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import column, day, exchanges, series
from tidemark.operators import features, fill


def _random_series(seed):
    rnd = random.Random(seed)
    return [None if rnd.random() < 0.4 else round(rnd.uniform(-50, 50), 2) for _ in range(rnd.randint(1, 25))]


def _table(spark, many):
    out = None
    for k, values in many.items():
        one = series(spark, values, k)
        out = one if out is None else out.unionByName(one)
    return out


def _check(df, many, expected):
    got = {k: [] for k in many}
    for r in df.orderBy("k", "date").collect():
        got[r.k].append(r.value)
    for k, values in many.items():
        want = expected(pd.Series(values, dtype="float64"))
        np.testing.assert_allclose(np.array(got[k], dtype="float64"), want.to_numpy(), rtol=1e-12, atol=1e-9)


MANY = {f"s{i}": _random_series(i) for i in range(30)}


def test_linear_fill_is_interpolation_then_both_carries(spark):
    _check(fill.linear_fill(_table(spark, MANY), ["k"], ["value"]), MANY, lambda s: s.interpolate().ffill().bfill())


def test_interpolate_keeps_leading_nulls(spark):
    _check(fill.interpolate(_table(spark, MANY), ["k"], ["value"]), MANY, lambda s: s.interpolate().ffill())


def test_interpolate_or_mean(spark):
    def expected(s):
        s = s.interpolate()
        return s.fillna(s.mean())

    _check(fill.interpolate_or_mean(_table(spark, MANY), ["k"], "value"), MANY, expected)


def test_carry_then_zero(spark):
    _check(fill.carry_then_zero(_table(spark, MANY), ["k"], ["value"]), MANY, lambda s: s.ffill().fillna(0))


def test_fill_does_not_cross_series(spark):
    two = _table(spark, {"a": [1, 2], "b": [None, 5]})
    assert column(fill.linear_fill(two, ["k"], ["value"]).filter("k = 'b'"), "value") == [5.0, 5.0]


def test_all_null_series_stays_null(spark):
    assert column(fill.linear_fill(series(spark, [None, None]), ["k"], ["value"]), "value") == [None, None]


def test_rejects_what_carrying_cannot_fill(spark):
    df = _table(spark, {"good": [1, None, 3], "bad": [None, 2, 3]})
    complete, rejected = fill.carry_forward_or_reject(df, ["k"], "value")
    assert column(complete, "value") == [1.0, 1.0, 3.0]
    assert [tuple(r) for r in rejected.collect()] == [("bad", 1)]


def test_text_columns_are_carried(spark):
    df = spark.createDataFrame([("a", day(0), 1.0, "x"), ("a", day(1), None, None), ("a", day(2), 3.0, None)],
                               "k string, date date, value double, note string")
    out = fill.repair_observations(df, ["k"], ["value"], ["note"])
    assert column(out, "value") == [1.0, 2.0, 3.0] and column(out, "note") == ["x", "x", "x"]


def test_the_known_outlier_list(spark):
    values = [1, 2, 3, 4, 5, 100, 2, 3, 4, 5]
    out = column(fill.outliers_to_median(series(spark, values), ["k"]), "value")
    assert out == [float(v) if v != 100 else 3.5 for v in values]


def test_gaps_are_laid_out_and_filled(spark):
    df = series(spark, [1, 4, 5], days=[0, 3, 5])
    assert column(fill.daily_continuity(df, ["k"]), "value") == [1, 2, 3, 4, 4.5, 5]
    assert column(fill.daily_spine(df, ["k"]), "date") == [day(i) for i in range(6)]


def test_rows_of_one_day_are_kept(spark):
    df = series(spark, [1, 2, 9], days=[0, 0, 2])
    assert fill.on_daily_spine(df, ["k"]).count() == 4


def test_spine_over_month_and_year_ends(spark):
    df = series(spark, [1, 2], days=[20, 430])
    got = column(fill.daily_spine(df, ["k"]), "date")
    assert got == [day(i) for i in range(20, 431)]
    assert column(fill.on_daily_spine(df, ["k"]), "date") == got


def test_modelling_table_is_one_shuffle(spark):
    df = fill.modelling_table(series(spark, range(50)), ["k"])
    df.write.format("noop").mode("overwrite").save()
    assert exchanges(df) == 1


def test_modelling_table_against_pandas(spark):
    values = [None, 5, 6, None, 8, 200, 7, 6, 5, None, 4, 6, 7, 8, 9, 7, 5, None]
    out = fill.modelling_table(series(spark, values), ["k"]).orderBy("date").toPandas()
    s = pd.Series(values, dtype="float64").interpolate().ffill().bfill()
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    s[(s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))] = s.median()
    np.testing.assert_allclose(out["value"], s)
    np.testing.assert_allclose(out["lag_7"], s.shift(7))
    np.testing.assert_allclose(out["rolling_mean_7"], s.rolling(7).mean())
    np.testing.assert_allclose(out["rolling_std_14"], s.rolling(14).std())
    assert out["rolling_mean_30"].isna().all()
    dates = pd.to_datetime(out["date"])
    assert (out["day_of_week"] == dates.dt.dayofweek).all()
    assert (out["is_weekend"] == (dates.dt.dayofweek >= 5).astype(int)).all()


def test_forecast_input_parts(spark):
    out = fill.forecast_input(series(spark, [None, 2, 4]), ["k"]).orderBy("date").first()
    assert (out.value, out.year, out.month, out.day, out.dayofweek, out.dayofyear, out.quarter) == (3.0, 2024, 1, 1, 0, 1, 1)


def test_number_days(spark):
    df = spark.createDataFrame([("a", 10, 1.0), ("a", 5, 2.0)], "k string, seq int, value double")
    assert [(str(r.date), r.value) for r in fill.number_days(df, ["k"], "seq").orderBy("date").collect()] == [
        ("2020-01-01", 2.0), ("2020-01-02", 1.0)
    ]


@pytest.mark.parametrize("n", [3, 8, 40])
def test_features_against_pandas(spark, n):
    rnd = random.Random(n)
    values = [round(rnd.uniform(0, 100), 1) for _ in range(n)]
    out = features.feature_table(series(spark, values), ["k"]).orderBy("date").toPandas()
    s = pd.Series(values)
    for lag in features.MODEL_LAGS:
        np.testing.assert_allclose(out[f"lag_{lag}"], s.shift(lag).ffill().fillna(0))
    for w in features.MODEL_WINDOWS:
        for stat in ("mean", "std", "min", "max"):
            want = getattr(s.rolling(w), stat)().ffill().fillna(0)
            np.testing.assert_allclose(out[f"rolling_{stat}_{w}"], want, atol=1e-9)
    assert list(out["trend"]) == list(range(n)) and list(out["trend_squared"]) == [i * i for i in range(n)]
    doy = pd.to_datetime(out["date"]).dt.dayofyear
    np.testing.assert_allclose(out["day_sin"], np.sin(2 * np.pi * doy / 365.25))


def test_feature_families_can_be_left_out(spark):
    out = features.feature_table(series(spark, range(5)), ["k"], lags=False, rolling=False, dates=False)
    assert out.columns == ["k", "date", "value", "trend", "trend_squared"]


def test_sequence_windows(spark):
    rows = features.sequence_windows(series(spark, range(10)), ["k"]).orderBy("date").collect()
    assert [(r.inputs, r.target) for r in rows] == [([float(j) for j in range(i - 7, i)], float(i)) for i in range(7, 10)]


def test_climate_block_is_all_or_nothing(spark):
    df = series(spark, [1, 2])
    assert features.align_climate(df, df.withColumn("temperature", F.lit(1.0)), ["k"]).columns == df.columns


def test_climate_resample_sums_zero_on_missing_days(spark):
    cols = "k string, date date, temperature double, humidity double, pressure double, wind_speed double, precipitation double"
    w = spark.createDataFrame([("a", day(0), 1.0, 1.0, 1.0, 1.0, 2.0), ("a", day(0), 3.0, 1.0, 1.0, 1.0, 2.0),
                               ("a", day(2), 5.0, 1.0, 1.0, 1.0, None)], cols)
    out = features.resample_climate(w, ["k"])
    assert column(out, "precipitation") == [4.0, 0.0, 0.0] and column(out, "temperature") == [2.0, None, 5.0]
    aligned = features.align_climate(series(spark, range(4), days=[-1, 0, 1, 3]), w, ["k"])
    assert column(aligned, "weather_temperature") == [2.0, 2.0, 2.0, 2.0]
