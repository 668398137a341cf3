import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import column, day, exchanges, series
from tidemark.functions.numeric import normal_quantile
from tidemark.operators import features, forecast
from tidemark.operators.forecast import Harmonic
from tidemark.plans import forecasting


def _values(n, seed=1):
    rnd = random.Random(seed)
    return [round(100 + 0.3 * i + 10 * np.sin(2 * np.pi * i / 7) + rnd.gauss(0, 2), 3) for i in range(n)]


def _design(n, spec):
    t = np.arange(n)
    cols = [np.ones(n)]
    if spec.use_trend:
        damped = (1 - spec.damping ** t) * spec.damping / (1 - spec.damping)
        cols.append(damped if spec.use_damped_trend else t / 1000)
    for p in spec.periods:
        for h in range(1, spec.harmonics + 1):
            cols += [np.sin(2 * np.pi * h * t / p), np.cos(2 * np.pi * h * t / p)]
    return np.column_stack(cols)


SPECS = [Harmonic(periods=(7,)), Harmonic(periods=(7, 30), use_damped_trend=True), Harmonic(periods=(7,), use_trend=False)]


@pytest.mark.parametrize("spec", SPECS)
def test_fit_is_least_squares(spark, spec):
    values = _values(120)
    df = series(spark, values)
    params = forecast.fit_harmonic(df, ["k"], spec)
    row = params.first()
    x = _design(120, spec)
    beta, *_ = np.linalg.lstsq(x, np.array(values), rcond=None)
    assert row.status == "ok" and row.n == 120
    fitted = column(forecast.fitted_values(df, params, ["k"], spec), "fitted")
    np.testing.assert_allclose(fitted, x @ beta, rtol=1e-7)
    sse = sum((v - f) ** 2 for v, f in zip(values, fitted))
    assert sse <= sum((v - np.mean(values)) ** 2 for v in values)


def test_far_origin_is_as_exact(spark):
    values = _values(40)
    df = series(spark, values, days=range(20000, 20040))
    spec = Harmonic(periods=(7,))
    fitted = column(forecast.fitted_values(df, forecast.fit_harmonic(df, ["k"], spec), ["k"], spec), "fitted")
    beta, *_ = np.linalg.lstsq(_design(40, spec), np.array(values), rcond=None)
    np.testing.assert_allclose(fitted, _design(40, spec) @ beta, rtol=1e-7)


def test_short_series_go_without_long_seasons(spark):
    df = series(spark, _values(60), "long").unionByName(series(spark, _values(10), "short")).unionByName(series(spark, [5], "one"))
    rows = {r.k: r for r in forecast.fit_harmonic(df, ["k"], Harmonic(periods=(7, 365))).collect()}
    assert (rows["long"].status, rows["long"].n_terms) == ("reduced", 6)
    assert (rows["short"].status, rows["short"].n_terms) == ("reduced", 2)
    assert rows["one"].status == "too_short"


def test_forecast_and_bounds(spark):
    values = _values(70)
    df, spec = series(spark, values), Harmonic(periods=(7,))
    params = forecast.fit_harmonic(df, ["k"], spec)
    fitted = forecast.fitted_values(df, params, ["k"], spec)
    rows = forecast.predict_harmonic(params, fitted, ["k"], 10, spec, confidence=0.9).orderBy("step").collect()
    beta, *_ = np.linalg.lstsq(_design(70, spec), np.array(values), rcond=None)
    np.testing.assert_allclose([r.forecast for r in rows], (_design(80, spec) @ beta)[70:], rtol=1e-7)
    assert [r.date for r in rows] == [day(i) for i in range(70, 80)]
    sd = np.std(np.array(values) - _design(70, spec) @ beta)
    assert rows[0].upper_bound - rows[0].forecast == pytest.approx(1.6448536 * sd, rel=1e-6)


def test_holiday_regressor(spark):
    values = [10.0 + (5 if i % 10 == 0 else 0) for i in range(40)]
    calendar = spark.createDataFrame([(day(i),) for i in range(0, 60, 10)], "date date")
    df, spec = features.flag_dates(series(spark, values), calendar), Harmonic(periods=(), use_trend=False, regressors=("is_holiday",))
    params = forecast.fit_harmonic(df, ["k"], spec)
    fitted = forecast.fitted_values(df, params, ["k"], spec)
    future = calendar.withColumn("is_holiday", F.lit(1))
    got = column(forecast.predict_harmonic(params, fitted, ["k"], 3, spec, future=future), "forecast")
    np.testing.assert_allclose(got, [15, 10, 10])
    plain = column(forecast.predict_harmonic(params, fitted, ["k"], 3, spec), "forecast")
    np.testing.assert_allclose(plain, [10, 10, 10])


def test_normal_quantile():
    assert normal_quantile(0.95) == pytest.approx(1.959964, abs=1e-6)


def test_simple_models(spark):
    values = [float(v) for v in (1, 4, 2, 8, 5, 7, 3, 9, 6, 10, 4, 8)]
    state = forecast.fit_simple(series(spark, values), ["k"])
    rows = {}
    for r in forecast.predict_simple(state, ["k"], 9).orderBy("step").collect():
        rows.setdefault(r.model, []).append(r.forecast)
    assert rows["seasonal_naive"] == [values[-7 + i % 7] for i in range(9)]
    assert rows["mean"] == [pytest.approx(np.mean(values))] * 9
    np.testing.assert_allclose(rows["drift"], [8 + h * (8 - 1) / 11 for h in range(1, 10)])
    d = np.diff(values)
    slope, level = np.polyfit(d[:-1], d[1:], 1)
    expected, last, step = [], values[-1], d[-1]
    for _ in range(9):
        step = level + slope * step
        last += step
        expected.append(last)
    np.testing.assert_allclose(rows["autoregressive"], expected)


def test_models_without_state_give_no_rows(spark):
    state = forecast.fit_simple(series(spark, [3, 4]), ["k"])
    assert {r.model for r in forecast.predict_simple(state, ["k"], 2).collect()} == {"mean", "drift"}
    one = forecast.fit_simple(series(spark, [3]), ["k"])
    assert {r.model for r in forecast.predict_simple(one, ["k"], 2).collect()} == {"mean"}


def test_metrics_and_summary(spark):
    values = _values(30)
    fitted = forecast.seasonal_naive_fit(series(spark, values), ["k"])
    s = pd.Series(values)
    r = (s - s.shift(7)).dropna()
    row = forecast.fit_metrics(fitted, ["k"]).first()
    assert row.rmse == pytest.approx(np.sqrt((r ** 2).mean()), abs=1e-4)
    assert row.mape == pytest.approx((r / s.shift(7).dropna()).abs().mean() * 100, abs=1e-2)
    assert row.residual_std == pytest.approx(r.std(ddof=0), abs=1e-4)
    summary = forecast.model_summary(fitted, ["k"], 3).first()
    n = len(r)
    assert summary.aic == pytest.approx(n * np.log((r ** 2).sum() / n) + 6)
    assert summary.bic == pytest.approx(n * np.log((r ** 2).sum() / n) + 3 * np.log(n))


def test_perfect_and_zero_fits_do_not_fail(spark):
    fitted = forecast.seasonal_naive_fit(series(spark, [0] * 20), ["k"])
    row = forecast.fit_metrics(fitted, ["k"]).first()
    assert (row.rmse, row.mape) == (0.0, None)
    assert forecast.model_summary(fitted, ["k"], 1).first().aic is None
    assert {r.acf for r in forecast.autocorrelation(fitted, ["k"]).collect()} == {None}
    assert [(r.bin, r.n_rows) for r in forecast.residual_histogram(fitted, ["k"]).collect()] == [(15, 13)]


def test_cross_validation(spark):
    values = _values(23)
    size, scores = 23 // 5, []
    for i in range(5):
        test, train = values[i * size:(i + 1) * size], values[:i * size] + values[(i + 1) * size:]
        e = np.array(test) - np.mean(train)
        scores.append((np.abs(e).mean(), np.sqrt((e ** 2).mean()), np.abs(e / np.array(test)).mean() * 100))
    for row in (forecast.cross_validate_mean(series(spark, values), ["k"]).first(),
                forecast.cross_validate_harmonic(series(spark, values), ["k"], Harmonic(periods=(), use_trend=False)).first()):
        np.testing.assert_allclose([row.mae_mean, row.rmse_mean, row.mape_mean], np.mean(scores, axis=0))


def test_cross_validated_refits(spark):
    values, spec = _values(60), Harmonic(periods=(7,), harmonics=1)
    x, y, size, scores = _design(60, spec), np.array(values), 12, []
    for i in range(5):
        held = np.zeros(60, dtype=bool)
        held[i * size:(i + 1) * size] = True
        beta, *_ = np.linalg.lstsq(x[~held], y[~held], rcond=None)
        scores.append(np.abs(y[held] - x[held] @ beta).mean())
    row = forecast.cross_validate_harmonic(series(spark, values), ["k"], spec).first()
    assert row.mae_mean == pytest.approx(np.mean(scores), rel=1e-6)


def test_ensemble(spark):
    rows = [("a", 1, day(0), m, f, f - 1, f + 1) for m, f in (("x", 10.0), ("y", 20.0))]
    df = spark.createDataFrame(rows, "k string, step int, date date, model string, forecast double, lower_bound double, upper_bound double")
    one = forecast.ensemble(df, ["k"]).first()
    assert (one.forecast, one.lower_bound, one.upper_bound, one.model) == (15.0, 14.0, 16.0, "ensemble")
    assert forecast.ensemble(df, ["k"], {"x": 0.75}).first().forecast == 12.5
    assert forecast.ensemble(df, ["k"], {"x": 0.0, "y": 0.0}).first().forecast is None
    assert forecast.ensemble(df, ["k"], enabled=False, single="y").first().forecast == 20.0


def test_autocorrelation_and_histogram(spark):
    values = _values(40)
    fitted = forecast.seasonal_naive_fit(series(spark, values), ["k"])
    r = np.array(column(fitted, "residual"))
    c = r - r.mean()
    got = column(forecast.autocorrelation(fitted, ["k"], 5), "acf", "lag")
    np.testing.assert_allclose(got, [(c[k:] * c[:len(c) - k]).sum() / (c * c).sum() for k in range(6)])
    counts = {x.bin: x.n_rows for x in forecast.residual_histogram(fitted, ["k"], 10).collect()}
    assert [counts.get(i, 0) for i in range(10)] == list(np.histogram(r, 10)[0])


def test_training_keeps_going_where_a_series_fails(spark):
    df = series(spark, _values(40), "good").unionByName(series(spark, [1, 2], "short")).unionByName(
        series(spark, [None] * 15 + _values(25), "holes"))
    rows = {(r.k, r.model): r.status for r in forecast.train_all(df, ["k"], spec=Harmonic(periods=(7,))).collect()}
    assert rows[("good", "harmonic")] == "ok" and rows[("good", "autoregressive")] == "ok"
    assert {s for (k, _), s in rows.items() if k == "short"} == {"too_short"}
    assert {s for (k, _), s in rows.items() if k == "holes"} == {"too_many_nulls"}
    listing = {(r.model, r.status): r.n_series for r in forecast.model_listing(forecast.train_all(df, ["k"])).collect()}
    assert listing[("mean", "ok")] == 1


def test_run(spark):
    df = series(spark, _values(60), "a").unionByName(series(spark, _values(60, 2), "b")).unionByName(series(spark, [1], "c"))
    out = forecasting.run(df, ["k"], 5, Harmonic(periods=(7,)))
    assert out.predictions.count() == 2 * 5 * 5
    assert {r.k for r in out.combined.collect()} == {"a", "b"}
    assert out.metrics.count() == 2


def test_fit_shuffles_once_by_key(spark):
    assert exchanges(forecast.fit_simple(series(spark, range(20)), ["k"])) == 1
    assert exchanges(forecast.fit_harmonic(series(spark, range(20)), ["k"])) <= 2


def test_comparison_ranks_models_by_their_cross_validation(spark):
    df = series(spark, _values(100), "weekly").unionByName(series(spark, [5.0] * 10, "short"))
    spec = Harmonic(periods=(7,))
    trained = forecast.train_all(df, ["k"], spec=spec, min_rows=30)
    rows = {(r.k, r.model): r for r in forecast.model_comparison(trained, forecast.cross_validated(df, ["k"], spec), ["k"]).collect()}
    assert len(rows) == 10
    assert rows["weekly", "harmonic"].rank == 1 and rows["weekly", "mean"].rank == 2 and rows["weekly", "drift"].rank is None
    assert rows["weekly", "harmonic"].rmse_mean < rows["weekly", "mean"].rmse_mean
    assert all(rows["short", m].rmse_mean is None and rows["short", m].rank is None for m in ("mean", "harmonic"))
