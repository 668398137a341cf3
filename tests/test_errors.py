"""Autocorrelated errors and the seasonal ARIMA against numpy on whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import column, day, exchanges, series
from tests.test_forecast import _design
from tidemark.operators import arima, errors, forecast
from tidemark.operators.forecast import Harmonic


def _many(spark, values, days=None):
    frames = [(k, day(t if days is None else days[t]), float(v)) for k, own in values.items() for t, v in enumerate(own)]
    return spark.createDataFrame(frames, "k string, date date, value double")


def _autoregressive(rng, n, phi, noise=1.0):
    e = np.zeros(n + 50)
    for t in range(len(phi), n + 50):
        e[t] = sum(f * e[t - 1 - i] for i, f in enumerate(phi)) + rng.normal(0, noise)
    return e[50:]


def _expected(y, spec, order):
    """The same steps with explicit rows and lags."""
    n, x = len(y), _design(len(y), spec)
    late = np.arange(order, n)
    beta = np.linalg.lstsq(x[late], y[late], rcond=None)[0]
    r = y - x @ beta
    c = np.array([(r[late] * r[late - k]).sum() for k in range(order + 1)])
    toeplitz = np.array([[c[abs(i - j)] for j in range(order)] for i in range(order)])
    phi = np.linalg.solve(toeplitz, c[1:])
    xs = x[late] - sum(phi[k] * x[late - k - 1] for k in range(order))
    ys = y[late] - sum(phi[k] * y[late - k - 1] for k in range(order))
    beta = np.linalg.lstsq(xs, ys, rcond=None)[0]
    sigma = np.sqrt(np.mean((ys - xs @ beta) ** 2))
    return x, beta, phi, sigma, y - x @ beta


SPECS = [Harmonic(periods=(7,)), Harmonic(periods=(7,), use_damped_trend=True), Harmonic(periods=(), use_trend=True)]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("spec", SPECS)
def test_fit_and_forecast_equal_numpy(spark, spec, order):
    rng = np.random.default_rng(order)
    values = {f"s{i}": 50 + 0.1 * np.arange(80 + i) + 3 * np.sin(np.arange(80 + i) * 2 * np.pi / 7) + _autoregressive(rng, 80 + i, (0.6, -0.2)) for i in range(50)}
    params = errors.fit_autocorrelated(_many(spark, values), ["k"], spec, order)
    rows = {r.k: r for r in params.collect()}
    ahead = {}
    for r in errors.predict_autocorrelated(params, ["k"], 5, spec).orderBy("step").collect():
        ahead.setdefault(r.k, []).append(r)
    assert len(rows) == 50
    for k, y in values.items():
        x, beta, phi, sigma, r = _expected(y, spec, order)
        np.testing.assert_allclose(rows[k].phi, phi, rtol=1e-5, atol=1e-8)
        np.testing.assert_allclose(_design(len(y), spec) @ np.array(rows[k].coefficients), x @ beta, rtol=1e-5)
        assert rows[k].sigma == pytest.approx(sigma, rel=1e-5) and rows[k].status == "ok" and rows[k].n == len(y) - order
        past, psi = list(r[::-1][:order]), [1.0]
        future = _design(len(y) + 5, spec)[len(y):]
        for h in range(5):
            e = sum(f * p for f, p in zip(phi, past))
            past.insert(0, e)
            sd = sigma * np.sqrt(sum(p * p for p in psi))
            psi.append(sum(phi[i] * psi[-1 - i] for i in range(min(order, len(psi)))))
            assert ahead[k][h].forecast == pytest.approx(future[h] @ beta + e, rel=1e-5)
            assert (ahead[k][h].upper_bound - ahead[k][h].forecast) / 1.959963984540054 == pytest.approx(sd, rel=1e-5)
            assert ahead[k][h].date == day(len(y) + h)


def test_order_is_chosen_per_series(spark):
    rng = np.random.default_rng(4)
    values = {"none": 5 + rng.normal(0, 1, 400), "one": _autoregressive(rng, 400, (0.7,)), "two": _autoregressive(rng, 400, (0.3, 0.5))}
    rows = {r.k: r.phi for r in errors.fit_autocorrelated(_many(spark, values), ["k"], Harmonic(periods=(), use_trend=False), 3, choose=True).collect()}
    assert abs(rows["none"][0]) < 0.15 and rows["one"][0] > 0.5 and rows["two"][1] > 0.3


def test_regressors_gaps_and_short_series(spark):
    rng = np.random.default_rng(5)
    spec = Harmonic(periods=(), regressors=("is_holiday",))
    holiday = (np.arange(60) % 10 == 0).astype(float)
    y = 10 + 5 * holiday + _autoregressive(rng, 60, (0.5,), 0.1)
    df = _many(spark, {"a": y}).withColumn("is_holiday", F.when(F.datediff("date", F.lit(day(0))) % 10 == 0, 1).otherwise(0))
    params = errors.fit_autocorrelated(df, ["k"], spec, 1)
    assert params.first().coefficients[2] == pytest.approx(5, abs=0.2)
    future = spark.createDataFrame([(day(60), 1)], "date date, is_holiday int")
    with_day, without = (column(errors.predict_autocorrelated(params, ["k"], 1, spec, future=f), "forecast")[0] for f in (future, None))
    assert with_day - without == pytest.approx(params.first().coefficients[2])
    plain = Harmonic(periods=())
    gap = series(spark, y[:40], days=[*range(20), *range(25, 45)])
    assert errors.fit_autocorrelated(gap, ["k"], plain, 2).first().n == 36
    short = series(spark, [1, None, 3], "s").unionByName(series(spark, [2], "t"))
    assert {(r.k, r.status, r.coefficients) for r in errors.fit_autocorrelated(short, ["k"], plain, 2).collect()} == {("s", "too_short", None), ("t", "too_short", None)}
    assert errors.predict_autocorrelated(errors.fit_autocorrelated(short, ["k"], plain, 2), ["k"], 3, plain).count() == 0


def test_errors_that_lag_beat_independent_ones(spark):
    rng = np.random.default_rng(6)
    values = {f"s{i}": 100 + _autoregressive(rng, 201, (0.9,)) for i in range(20)}
    spec = Harmonic(periods=(), use_trend=False)
    train = _many(spark, {k: v[:200] for k, v in values.items()})
    params = errors.fit_autocorrelated(train, ["k"], spec, 1)
    lagged = {r.k: r.forecast for r in errors.predict_autocorrelated(params, ["k"], 1, spec).collect()}
    error = lambda f: np.mean([(f(k) - v[200]) ** 2 for k, v in values.items()])
    assert error(lagged.get) < 0.6 * error(lambda k: values[k][:200].mean())


def test_one_read_serves_both_passes(spark, tmp_path):
    _many(spark, {"a": np.arange(50.0)}).write.parquet(str(tmp_path / "t"))
    params = errors.fit_autocorrelated(spark.read.parquet(str(tmp_path / "t")), ["k"], Harmonic(periods=(7,)), 2)
    plan = params._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and exchanges(params) == 1


def _hannan_rissanen(y, season=7, long=15):
    w = np.full(len(y), np.nan)
    s = season
    w[s + 1:] = y[s + 1:] - y[s:-1] - y[1:len(y) - s] + y[:-s - 1]
    first = np.arange(s + 1 + long, len(y))
    x = np.column_stack([w[first - k] for k in range(1, long + 1)])
    pi = np.linalg.lstsq(x, w[first], rcond=None)[0]
    a = np.full(len(y), np.nan)
    a[first] = w[first] - x @ pi
    late = np.arange(s + 1 + long + s + 1, len(y))
    x = np.column_stack([z[late - k] for z in (w, a) for k in (1, s, s + 1)])
    b = np.linalg.lstsq(x, w[late], rcond=None)[0]
    sse = ((w[late] - x @ b) ** 2).sum()
    past_y, past_w, past_a, out = list(y), list(w), list(a), []
    for _ in range(10):
        nw = sum(c * z[-k] for c, (z, k) in zip(b, [(z, k) for z in (past_w, past_a) for k in (1, s, s + 1)]))
        out.append(nw + past_y[-1] + past_y[-s] - past_y[-s - 1])
        past_y.append(out[-1]), past_w.append(nw), past_a.append(0.0)
    return b, len(late), sse, out


def _weekly(rng, n, noise=1.0):
    return 100 + 0.2 * np.arange(n) + np.tile(rng.normal(0, 8, 7), n // 7 + 1)[:n] + np.cumsum(rng.normal(0, 0.3, n)) + rng.normal(0, noise, n)


def test_seasonal_arima_equals_numpy(spark):
    rng = np.random.default_rng(7)
    values = {f"s{i}": _weekly(rng, 150 + 3 * i) for i in range(20)}
    params = arima.fit_seasonal_arima(_many(spark, values), ["k"])
    rows, ahead = {r.k: r for r in params.collect()}, {}
    for r in arima.predict_seasonal_arima(params, ["k"], 10).orderBy("step").collect():
        ahead.setdefault(r.k, []).append(r)
    for k, y in values.items():
        b, n, sse, out = _hannan_rissanen(y)
        np.testing.assert_allclose([*rows[k].ar, *rows[k].ma], b, rtol=1e-4, atol=1e-7)
        assert rows[k].n == n and rows[k].sigma == pytest.approx(np.sqrt(sse / n), rel=1e-6)
        assert rows[k].aic == pytest.approx(n * np.log(sse / n) + 14, rel=1e-6)
        np.testing.assert_allclose([r.forecast for r in ahead[k]], out, rtol=1e-5)
        width = [r.upper_bound - r.lower_bound for r in ahead[k]]
        assert all(a <= b + 1e-9 for a, b in zip(width, width[1:])) and rows[k].status in ("ok", "explosive")


def test_seasonal_arima_beats_the_plain_autoregression_on_weekly_series(spark):
    rng = np.random.default_rng(8)
    values = {f"s{i}": _weekly(rng, 217) for i in range(15)}
    train = _many(spark, {k: v[:210] for k, v in values.items()})
    error = lambda rows: np.mean([(r.forecast - values[r.k][209 + r.step]) ** 2 for r in rows])
    seasonal = arima.predict_seasonal_arima(arima.fit_seasonal_arima(train, ["k"]), ["k"], 7).collect()
    plain = forecast.predict_simple(forecast.fit_simple(train, ["k"]), ["k"], 7, models=("autoregressive",)).collect()
    assert len(seasonal) == len(plain) == 105 and error(seasonal) < 0.5 * error(plain)


def _integrated(rng, phi, n):
    w, y = [0.0] * 8, [100.0] * 8
    for _ in range(n):
        w.append(phi * w[-1] + rng.normal())
        y.append(w[-1] + y[-1] + y[-7] - y[-8])
    return y


def test_every_series_has_a_status(spark):
    rng = np.random.default_rng(9)
    values = {"good": _weekly(rng, 200), "short": _weekly(rng, 40), "tiny": [1.0], "flat": [5.0] * 200,
              "explosive": _integrated(rng, 1.05, 150)}
    df = _many(spark, values).unionByName(series(spark, _weekly(rng, 100), "gap", days=[2 * i for i in range(100)]))
    rows = {r.k: r for r in arima.fit_seasonal_arima(df, ["k"]).collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "good": "ok", "short": "too_short", "tiny": "too_short", "flat": "rank_deficient", "explosive": "explosive", "gap": "too_short"}
    assert rows["tiny"].last_date == day(0) and rows["short"].ar is None
    flat = arima.predict_seasonal_arima(arima.fit_seasonal_arima(df.filter("k = 'flat'"), ["k"]), ["k"], 3).collect()
    assert [r.forecast for r in flat] == [5.0] * 3
