"""Forecasting, evaluation, ensembles and residual learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import normal_quantile
from ..operators import arima, choice, clean, errors, features, fill, forecast, residual, series_forest
from ..operators.forecast import Harmonic
from ..plans import forecasting
from ..sources import models
from ..storage import fresh_path, materialise
from .inputs import KEY, ctes, cust_events, cust_orders, event_regions, nulled, holiday_dates, region_daily
from .registry import half_up, query, rounded, sql_with
from .series import interpolate_sql, spine_sql

REGION = ["region"]
STEPS = 7
BOUNDS = ("forecast", "lower_bound", "upper_bound")

CONTINUOUS = ",\n".join([
    spine_sql("spine", "region_daily", "region"),
    "spread AS (SELECT region, date, value FROM spine LEFT JOIN region_daily USING (region, date))",
    interpolate_sql("continuous", "spread", "region", ["value"], True),
])


def continuous(spark, sf_dir):
    """Daily totals per region without gaps."""
    return fill.daily_continuity(region_daily(spark, sf_dir), REGION)


def naive_sql(src: str, key: str) -> str:
    return f"""naive AS (
    SELECT {key}, date, value AS actual, fitted, value - fitted AS residual FROM (
        SELECT *, LAG(value, 7) OVER (PARTITION BY {key} ORDER BY date) AS fitted FROM {src}) WHERE fitted IS NOT NULL)"""


@query("fitted_and_residuals", "F8", sql_with(ctes("cust_events"), naive_sql("cust_events", "customer_id"), body=f"""
    SELECT customer_id, date, actual, fitted, {half_up('residual', 4)} AS residual FROM naive"""))
def fitted_and_residuals(spark, sf_dir):
    return rounded(forecast.seasonal_naive_fit(cust_events(spark, sf_dir), KEY), 4, "residual")


@query("fit_metrics", "A14", sql_with(ctes("cust_events"), naive_sql("cust_events", "customer_id"), body="""
    SELECT customer_id, ROUND(SQRT(AVG(residual * residual)), 4) AS rmse, ROUND(AVG(residual * residual), 4) AS mse,
           ROUND(AVG(ABS(residual)), 4) AS mae, ROUND(AVG(CASE WHEN fitted <> 0 THEN ABS(residual / fitted) END) * 100, 2) AS mape,
           ROUND(STDDEV_POP(residual), 4) AS residual_std, ROUND(AVG(residual), 4) AS residual_mean
    FROM naive GROUP BY customer_id"""))
def fit_metrics(spark, sf_dir):
    return forecast.fit_metrics(forecast.seasonal_naive_fit(cust_events(spark, sf_dir), KEY), KEY)


@query("model_summary", "F7", sql_with(ctes("cust_events"), naive_sql("cust_events", "customer_id"), body="""
    SELECT customer_id, n AS fitted_length, 1 AS parameters_count, ROUND(sd, 4) AS residual_std,
           ROUND(n * LN(sse / n) + 2, 4) AS aic, ROUND(n * LN(sse / n) + LN(n), 4) AS bic
    FROM (SELECT customer_id, COUNT(*) AS n, SUM(residual * residual) AS sse, STDDEV_POP(residual) AS sd
          FROM naive GROUP BY customer_id)"""))
def model_summary(spark, sf_dir):
    fitted = forecast.seasonal_naive_fit(cust_events(spark, sf_dir), KEY)
    return rounded(forecast.model_summary(fitted, KEY, 1), 4, "residual_std", "aic", "bic")


def simple_sql(src: str, key: str, steps: int = STEPS) -> str:
    """CTEs up to ``simple``: key, step, date, model, forecast, sd."""
    return f"""stepped AS (
    SELECT *, ROW_NUMBER() OVER w AS pos, COUNT(*) OVER (PARTITION BY {key}) AS n, LAG(value, 7) OVER w AS season_ago,
           value - LAG(value, 1) OVER w AS diff FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY date)),
lagged AS (SELECT *, LAG(diff, 1) OVER (PARTITION BY {key} ORDER BY date) AS diff_ago FROM stepped),
states AS (
    SELECT {key}, COUNT(*) AS n, MAX(date) AS last_date, ARG_MIN(value, pos) AS first_value, ARG_MAX(value, pos) AS last_value,
           ARG_MAX(diff, pos) AS last_diff, AVG(value) AS mean, STDDEV_POP(value) AS mean_sd,
           STDDEV_POP(value - season_ago) AS naive_sd, STDDEV_POP(diff) AS drift_sd, AVG(diff) AS drift,
           REGR_SLOPE(diff, diff_ago) AS slope, REGR_INTERCEPT(diff, diff_ago) AS level
    FROM lagged GROUP BY {key}),
ar_errors AS (
    SELECT {key}, STDDEV_POP(diff - (level + slope * diff_ago)) AS ar_sd
    FROM lagged JOIN states USING ({key}) WHERE diff_ago IS NOT NULL GROUP BY {key}),
steps AS (SELECT CAST(unnest(generate_series(1, {steps})) AS INTEGER) AS step),
ahead AS (
    SELECT *, last_date + step AS ahead_date, level / (1 - slope) AS rest,
           slope * (1 - POW(slope, step)) / (1 - slope) AS decay
    FROM states LEFT JOIN ar_errors USING ({key}) CROSS JOIN steps),
simple AS (
    SELECT {key}, step, ahead_date AS date, 'mean' AS model, mean AS forecast, mean_sd AS sd FROM ahead
    UNION ALL SELECT {key}, step, ahead_date, 'drift', last_value + step * drift, drift_sd FROM ahead WHERE drift IS NOT NULL
    UNION ALL SELECT {key}, step, ahead_date, 'autoregressive', last_value + step * rest + (last_diff - rest) * decay, ar_sd
        FROM ahead WHERE rest IS NOT NULL
    UNION ALL SELECT a.{key}, a.step, a.ahead_date, 'seasonal_naive', s.value, naive_sd
        FROM ahead AS a JOIN stepped AS s ON a.{key} = s.{key} AND s.pos = a.n - 6 + (a.step - 1) % 7 WHERE a.n > 7)"""


Z95 = repr(normal_quantile(0.95))
INTERVALS = f"""predictions AS (
    SELECT * EXCLUDE (sd), forecast - {Z95} * sd AS lower_bound, forecast + {Z95} * sd AS upper_bound FROM simple)"""
_ROUND_BOUNDS = ", ".join(f"ROUND({c}, 4) AS {c}" for c in BOUNDS)


def _simple(df, key):
    return forecast.predict_simple(forecast.fit_simple(df, key), key, STEPS)


@query("simple_forecasts", "F2 F4 M2", sql_with(
    ctes("cust_events"), simple_sql("cust_events", "customer_id"), INTERVALS,
    body=f"SELECT customer_id, step, date, model, {_ROUND_BOUNDS} FROM predictions"))
def simple_forecasts(spark, sf_dir):
    return rounded(_simple(cust_events(spark, sf_dir), KEY), 4, *BOUNDS)


@query("simple_forecasts_long_horizon", "F2 F4", sql_with(
    ctes("region_daily"), CONTINUOUS, simple_sql("continuous", "region", 30), INTERVALS,
    body=f"SELECT region, step, date, model, {_ROUND_BOUNDS} FROM predictions"))
def simple_forecasts_long_horizon(spark, sf_dir):
    state = forecast.fit_simple(continuous(spark, sf_dir), REGION)
    return rounded(forecast.predict_simple(state, REGION, 30), 4, *BOUNDS)


@query("autoregression", "F4", sql_with(
    ctes("region_daily"), CONTINUOUS, simple_sql("continuous", "region"),
    body="SELECT region, n, ROUND(slope, 6) AS slope, ROUND(level, 4) AS level, last_value FROM states"))
def autoregression(spark, sf_dir):
    state = forecast.fit_simple(continuous(spark, sf_dir), REGION)
    return rounded(rounded(state, 6, "slope"), 4, "level").select("region", "n", "slope", "level", "last_value")


ENSEMBLE = """weighted AS (
    SELECT *, CASE model WHEN 'mean' THEN 0.5 WHEN 'drift' THEN 0.1 ELSE 0.25 END AS w FROM predictions)"""


@query("ensemble_forecast", "A17", sql_with(
    ctes("cust_events"), simple_sql("cust_events", "customer_id"), INTERVALS, ENSEMBLE, body="""
    SELECT customer_id, step, date, 'ensemble' AS model, ROUND(SUM(forecast * w) / SUM(w), 4) AS forecast,
           ROUND(SUM(lower_bound * w) / SUM(w), 4) AS lower_bound, ROUND(SUM(upper_bound * w) / SUM(w), 4) AS upper_bound
    FROM weighted GROUP BY customer_id, step, date"""))
def ensemble_forecast(spark, sf_dir):
    predictions = _simple(cust_events(spark, sf_dir), KEY)
    return rounded(forecast.ensemble(predictions, KEY, {"mean": 0.5, "drift": 0.1}), 4, *BOUNDS)


@query("single_model_forecast", "A17", sql_with(
    ctes("cust_events"), simple_sql("cust_events", "customer_id"), INTERVALS,
    body=f"SELECT customer_id, step, date, model, {_ROUND_BOUNDS} FROM predictions WHERE model = 'seasonal_naive'"))
def single_model_forecast(spark, sf_dir):
    predictions = _simple(cust_events(spark, sf_dir), KEY)
    return rounded(forecast.ensemble(predictions, KEY, enabled=False, single="seasonal_naive"), 4, *BOUNDS)


@query("cross_validated_mean", "A16", sql_with(ctes("cust_events"), """folds AS (
    SELECT *, pos // size AS fold FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date) - 1 AS pos,
               COUNT(*) OVER (PARTITION BY customer_id) // 5 AS size FROM cust_events)),
trained AS (
    SELECT f.customer_id, f.fold, f.value, (SELECT AVG(o.value) FROM folds AS o
           WHERE o.customer_id = f.customer_id AND o.fold <> f.fold) AS mean_value
    FROM folds AS f WHERE f.fold < 5),
scored AS (
    SELECT customer_id, fold, AVG(ABS(value - mean_value)) AS mae, SQRT(AVG(POW(value - mean_value, 2))) AS rmse,
           AVG(CASE WHEN value <> 0 THEN ABS((value - mean_value) / value) END) * 100 AS mape
    FROM trained GROUP BY customer_id, fold)""", body="""
    SELECT customer_id, ROUND(AVG(mae), 4) AS mae_mean, ROUND(AVG(rmse), 4) AS rmse_mean, ROUND(AVG(mape), 4) AS mape_mean
    FROM scored GROUP BY customer_id"""))
def cross_validated_mean(spark, sf_dir):
    return rounded(
        forecast.cross_validate_mean(cust_events(spark, sf_dir), KEY), 4, "mae_mean", "rmse_mean", "mape_mean"
    )


@query("residual_histogram", "A19", sql_with(ctes("region_daily"), naive_sql("region_daily", "region"), body="""
    SELECT region, bin, COUNT(*) AS n_rows FROM (
        SELECT region, CASE WHEN high = low THEN 15
               ELSE CAST(LEAST(29, FLOOR((residual - low) / (high - low) * 30)) AS INTEGER) END AS bin
        FROM (SELECT *, MIN(residual) OVER s AS low, MAX(residual) OVER s AS high FROM naive
              WINDOW s AS (PARTITION BY region)))
    GROUP BY region, bin"""))
def residual_histogram(spark, sf_dir):
    return forecast.residual_histogram(forecast.seasonal_naive_fit(region_daily(spark, sf_dir), REGION), REGION)


@query("residual_autocorrelation", "A20", sql_with(
    ctes("region_daily"), naive_sql("region_daily", "region"), """centred AS (
    SELECT region, ROW_NUMBER() OVER (PARTITION BY region ORDER BY date) AS pos,
           residual - AVG(residual) OVER (PARTITION BY region) AS r FROM naive),
lags AS (SELECT CAST(unnest(generate_series(0, 20)) AS INTEGER) AS lag)""", body="""
    SELECT a.region, lag, ROUND(SUM(a.r * b.r) / ANY_VALUE(t.total), 6) AS acf
    FROM centred AS a CROSS JOIN lags JOIN centred AS b ON a.region = b.region AND b.pos = a.pos - lag
    JOIN (SELECT region, SUM(r * r) AS total FROM centred GROUP BY region) AS t ON t.region = a.region
    GROUP BY a.region, lag"""))
def residual_autocorrelation(spark, sf_dir):
    fitted = forecast.seasonal_naive_fit(region_daily(spark, sf_dir), REGION)
    return rounded(forecast.autocorrelation(fitted, REGION), 6, "acf")


TREND_ONLY = Harmonic(periods=(), use_trend=True)


@query("trend_regression", "F1 F2", sql_with(ctes("cust_events"), """days AS (
    SELECT *, datediff('day', MIN(date) OVER s, date) / 1000.0::DOUBLE AS t FROM cust_events
    WINDOW s AS (PARTITION BY customer_id)),
lines AS (
    SELECT customer_id, COUNT(*) AS n, REGR_SLOPE(value, t) AS slope, REGR_INTERCEPT(value, t) AS level,
           MIN(date) AS origin, MAX(date) AS last_date FROM days GROUP BY customer_id),
spreads AS (
    SELECT customer_id, STDDEV_POP(value - (level + slope * t)) AS sd FROM days JOIN lines USING (customer_id)
    GROUP BY customer_id),
steps AS (SELECT CAST(unnest(generate_series(1, 7)) AS INTEGER) AS step),
points AS (
    SELECT customer_id, step, last_date + step AS date, sd,
           level + slope * (datediff('day', origin, last_date) + step) / 1000.0::DOUBLE AS forecast
    FROM lines JOIN spreads USING (customer_id) CROSS JOIN steps)""", body=f"""
    SELECT customer_id, step, date, 'trend' AS model, ROUND(forecast, 4) AS forecast,
           ROUND(forecast - {Z95} * sd, 4) AS lower_bound, ROUND(forecast + {Z95} * sd, 4) AS upper_bound FROM points"""))
def trend_regression(spark, sf_dir):
    df = cust_events(spark, sf_dir)
    params = forecast.fit_harmonic(df, KEY, TREND_ONLY)
    fitted = forecast.fitted_values(df, params, KEY, TREND_ONLY)
    return rounded(forecast.predict_harmonic(params, fitted, KEY, STEPS, TREND_ONLY, model="trend"), 4, *BOUNDS)


WEEKLY = Harmonic(periods=(7,), harmonics=3, use_trend=False)  # as many terms as weekdays: their means


def weekdays_sql(src: str, key: str) -> str:
    return f"""weekdays AS (
    SELECT {key}, date, value, datediff('day', origin, date) % 7 AS phase, origin
    FROM (SELECT *, MIN(date) OVER (PARTITION BY {key}) AS origin,
                 COUNT(*) OVER (PARTITION BY {key}) AS n FROM {src}) WHERE n >= 14),
weekly AS (
    SELECT *, AVG(value) OVER (PARTITION BY {key}, phase) AS fitted FROM weekdays)"""


@query("weekly_harmonic_fit", "F1 F8", sql_with(ctes("cust_events"), weekdays_sql("cust_events", "customer_id"), body="""
    SELECT customer_id, date, value AS actual, ROUND(fitted, 4) AS fitted, ROUND(value - fitted, 4) AS residual FROM weekly"""))
def weekly_harmonic_fit(spark, sf_dir):
    df = clean.with_min_history(cust_events(spark, sf_dir), KEY, 14)
    fitted = forecast.fitted_values(df, forecast.fit_harmonic(df, KEY, WEEKLY), KEY, WEEKLY)
    return rounded(fitted, 4, "fitted", "residual")


@query("holiday_effect_fit", "F5 J6", sql_with(ctes("event_regions", "holiday_dates"), body="""
    SELECT region, date, value AS actual, ROUND(AVG(value) OVER (
               PARTITION BY region, date IN (SELECT date FROM holiday_dates)), 4) AS fitted FROM event_regions"""))
def holiday_effect_fit(spark, sf_dir):
    spec = Harmonic(periods=(), use_trend=False, regressors=("is_holiday",))
    df = features.flag_dates(event_regions(spark, sf_dir), holiday_dates(spark, sf_dir))
    fitted = forecast.fitted_values(df, forecast.fit_harmonic(df, REGION, spec), REGION, spec)
    return rounded(fitted, 4, "fitted").drop("residual")


DAMPED_TREND = Harmonic(periods=(), use_damped_trend=True)


@query("damped_trend_summary", "F1 F7", sql_with(ctes("cust_events"), """days AS (
    SELECT customer_id, value, (1 - POW(0.98::DOUBLE, datediff('day', MIN(date) OVER s, date))) * (0.98::DOUBLE / 0.02::DOUBLE) AS x
    FROM cust_events WINDOW s AS (PARTITION BY customer_id)),
lines AS (
    SELECT customer_id, REGR_SLOPE(value, x) AS slope, REGR_INTERCEPT(value, x) AS level FROM days GROUP BY customer_id),
errors AS (SELECT customer_id, value - (level + slope * x) AS r FROM days JOIN lines USING (customer_id))""", body="""
    SELECT customer_id, n AS fitted_length, 2 AS parameters_count, ROUND(sd, 4) AS residual_std,
           ROUND(n * LN(sse / n) + 4, 4) AS aic, ROUND(n * LN(sse / n) + 2 * LN(n), 4) AS bic,
           '' AS seasonal_periods, TRUE AS use_trend, TRUE AS use_damped_trend
    FROM (SELECT customer_id, COUNT(*) AS n, SUM(r * r) AS sse, STDDEV_POP(r) AS sd FROM errors GROUP BY customer_id)"""))
def damped_trend_summary(spark, sf_dir):
    df = cust_events(spark, sf_dir)
    fitted = forecast.fitted_values(df, forecast.fit_harmonic(df, KEY, DAMPED_TREND), KEY, DAMPED_TREND)
    out = forecast.model_summary(fitted, KEY, len(DAMPED_TREND.terms()), DAMPED_TREND)
    return rounded(out, 4, "residual_std", "aic", "bic")


def design_sql(spec: Harmonic, n: str = "n") -> list[str]:
    """The value of each term at day ``t``, 0 where the ``n`` days of the series are too few for the season, as in ``Harmonic.design``."""
    out = ["1.0::DOUBLE"]
    if spec.use_trend:
        out.append("(1 - POW(0.98::DOUBLE, t)) * (0.98::DOUBLE / 0.02::DOUBLE)" if spec.use_damped_trend else "t / 1000.0::DOUBLE")
    for name, period in spec.terms():
        if period is not None:
            wave, _, h = name.split("_")
            out.append(f"CASE WHEN {n} >= {2 * period} THEN {wave}(t * (2 * pi() * {h} / {period})) ELSE 0 END")
    return out + [f"{r}::DOUBLE" for r in spec.regressors]


def solve_sql(rows: str, key: str, size: int, prefix: str = "") -> str:
    """CTEs from ``rows`` (the key, value, x0, x1, ...) to ``beta`` (the key, b0, b1, ...): the normal equations by elimination.

    ``prefix`` goes before the name of every CTE.
    """
    sums = [f"SUM(x{i} * x{j}) AS m_{i}_{j}" for i in range(size) for j in range(i, size)] + [f"SUM(x{i} * value) AS y_{i}" for i in range(size)]
    out, last = [f"{prefix}sums AS (SELECT {key}, {', '.join(sums)} FROM {rows} GROUP BY {key})"], f"{prefix}sums"
    for p in range(size - 1):
        new = []
        for i in range(p + 1, size):
            part = f"CASE WHEN m_{p}_{p} > 1e-9 THEN m_{p}_{i} / m_{p}_{p} ELSE 0 END"
            new += [f"m_{i}_{j} - {part} * m_{p}_{j} AS m_{i}_{j}" for j in range(i, size)] + [f"y_{i} - {part} * y_{p} AS y_{i}"]
        out.append(f"{prefix}step_{p} AS (SELECT * REPLACE ({', '.join(new)}) FROM {last})")
        last = f"{prefix}step_{p}"
    for i in range(size - 1, -1, -1):
        known = "".join(f" - m_{i}_{j} * b{j}" for j in range(i + 1, size))
        out.append(f"{prefix}back_{i} AS (SELECT *, CASE WHEN m_{i}_{i} > 1e-9 THEN (y_{i}{known}) / m_{i}_{i} ELSE 0 END AS b{i} FROM {last})")
        last = f"{prefix}back_{i}"
    return ",\n".join([*out, f"{prefix}beta AS (SELECT {key}, {', '.join(f'b{i}' for i in range(size))} FROM {last})"])


def harmonic_sql(src: str, key: str, spec: Harmonic) -> str:
    """CTEs up to ``fits`` (key, date, actual, fitted) and ``ends`` (key, n, origin, last_date, sd and coefficients)."""
    xs = design_sql(spec)
    more = "".join(f", {r}" for r in spec.regressors)
    total = " + ".join(f"b{i} * x{i}" for i in range(len(xs)))
    return f"""timed AS (
    SELECT *, datediff('day', origin, date)::DOUBLE AS t FROM (
        SELECT {key}, date, value{more}, MIN(date) OVER s AS origin, datediff('day', MIN(date) OVER s, MAX(date) OVER s) + 1 AS n
        FROM {src} WHERE value IS NOT NULL WINDOW s AS (PARTITION BY {key}))),
terms AS (SELECT *, {', '.join(f'{x} AS x{i}' for i, x in enumerate(xs))} FROM timed),
{solve_sql('terms', key, len(xs))},
fits AS (SELECT {key}, date, value AS actual, {total} AS fitted FROM terms JOIN beta USING ({key})),
ends AS (
    SELECT * FROM beta JOIN (SELECT {key}, STDDEV_POP(actual - fitted) AS sd FROM fits GROUP BY {key}) USING ({key})
    JOIN (SELECT {key}, MAX(n) AS n, MIN(date) AS origin, MAX(date) AS last_date FROM timed GROUP BY {key}) USING ({key}))"""


def harmonic_ahead_sql(key: str, spec: Harmonic, steps: int, model: str, digits: int, regressors: str = "") -> str:
    """The forecast from ``ends``; ``regressors`` are SQL columns of the days ahead."""
    total = " + ".join(f"b{i} * ({x})" for i, x in enumerate(design_sql(spec)))
    return f"""SELECT {key}, step, date, '{model}' AS model, ROUND(forecast, {digits}) AS forecast,
           ROUND(forecast - {Z95} * sd, {digits}) AS lower_bound, ROUND(forecast + {Z95} * sd, {digits}) AS upper_bound
    FROM (SELECT *, {total} AS forecast FROM (
        SELECT *, datediff('day', origin, date)::DOUBLE AS t{regressors} FROM (
            SELECT *, last_date + step AS date
            FROM ends CROSS JOIN (SELECT CAST(unnest(generate_series(1, {steps})) AS INTEGER) AS step))))"""


SEASONS = Harmonic()
DAMPED_WEEK = Harmonic(periods=(7,), use_damped_trend=True)
CALENDAR = Harmonic(periods=(7, 365), regressors=("is_holiday",))
WEEK = Harmonic(periods=(7,))


@query("cross_validated_trend", "A16 F1", sql_with(ctes("cust_events"), """folds AS (
    SELECT *, pos // size AS fold FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date) - 1 AS pos,
               datediff('day', MIN(date) OVER (PARTITION BY customer_id), date) / 1000.0::DOUBLE AS t,
               COUNT(*) OVER (PARTITION BY customer_id) // 5 AS size FROM cust_events)),
lines AS (
    SELECT f.customer_id, f.fold, REGR_SLOPE(o.value, o.t) AS slope, REGR_INTERCEPT(o.value, o.t) AS level
    FROM (SELECT DISTINCT customer_id, fold FROM folds WHERE fold < 5) AS f
    JOIN folds AS o ON o.customer_id = f.customer_id AND o.fold <> f.fold GROUP BY f.customer_id, f.fold),
errors AS (
    SELECT customer_id, fold, value, ABS(value - (level + slope * t)) AS e FROM folds JOIN lines USING (customer_id, fold)),
scored AS (
    SELECT customer_id, fold, AVG(e) AS mae, SQRT(AVG(e * e)) AS rmse,
           AVG(CASE WHEN value <> 0 THEN e / ABS(value) END) * 100 AS mape FROM errors GROUP BY customer_id, fold)""", body="""
    SELECT customer_id, ROUND(AVG(mae), 4) AS mae_mean, ROUND(AVG(rmse), 4) AS rmse_mean, ROUND(AVG(mape), 4) AS mape_mean
    FROM scored GROUP BY customer_id"""))
def cross_validated_trend(spark, sf_dir):
    out = forecast.cross_validate_harmonic(cust_events(spark, sf_dir), KEY, TREND_ONLY)
    return rounded(out, 4, "mae_mean", "rmse_mean", "mape_mean")


@query("harmonic_fit", "F1 F8", sql_with(ctes("region_daily"), CONTINUOUS, harmonic_sql("continuous", "region", SEASONS), body="""
    SELECT region, date, actual, ROUND(fitted, 2) AS fitted, ROUND(actual - fitted, 2) AS residual FROM fits"""))
def harmonic_fit(spark, sf_dir):
    df = materialise(continuous(spark, sf_dir), "continuous")
    return rounded(forecast.fitted_values(df, forecast.fit_harmonic(df, REGION), REGION), 2, "fitted", "residual")


@query("harmonic_forecast", "F1 F2", sql_with(
    ctes("region_daily"), CONTINUOUS, harmonic_sql("continuous", "region", SEASONS),
    body=harmonic_ahead_sql("region", SEASONS, 30, "harmonic", 2)))
def harmonic_forecast(spark, sf_dir):
    df = materialise(continuous(spark, sf_dir), "continuous")
    params = materialise(forecast.fit_harmonic(df, REGION), "params")
    fitted = forecast.fitted_values(df, params, REGION)
    return rounded(forecast.predict_harmonic(params, fitted, REGION, 30), 2, *BOUNDS)


@query("damped_harmonic_summary", "F1 F7", sql_with(
    ctes("cust_events"), harmonic_sql("cust_events", "customer_id", DAMPED_WEEK), body="""
    SELECT customer_id, n AS fitted_length, 6 AS parameters_count, ROUND(sd, 4) AS residual_std,
           ROUND(n * LN(sse / n) + 12, 4) AS aic, ROUND(n * LN(sse / n) + 6 * LN(n), 4) AS bic,
           '7' AS seasonal_periods, TRUE AS use_trend, TRUE AS use_damped_trend
    FROM (SELECT customer_id, COUNT(*) AS n, SUM(POW(actual - fitted, 2)) AS sse, STDDEV_POP(actual - fitted) AS sd
          FROM fits GROUP BY customer_id)"""))
def damped_harmonic_summary(spark, sf_dir):
    spec = DAMPED_WEEK
    df = cust_events(spark, sf_dir)
    fitted = forecast.fitted_values(df, forecast.fit_harmonic(df, KEY, spec), KEY, spec)
    out = forecast.model_summary(fitted, KEY, len(spec.terms()), spec)
    return rounded(out, 4, "residual_std", "aic", "bic")


@query("calendar_additive_forecast", "F5 J6", sql_with(
    ctes("region_daily"), CONTINUOUS, """holidays AS (SELECT DISTINCT date FROM continuous WHERE day(date) IN (1, 15)),
flagged AS (SELECT *, CASE WHEN date IN (SELECT date FROM holidays) THEN 1 ELSE 0 END AS is_holiday FROM continuous)""",
    harmonic_sql("flagged", "region", CALENDAR),
    body=harmonic_ahead_sql("region", CALENDAR, STEPS, "calendar", 2, ", CASE WHEN date IN (SELECT date FROM holidays) THEN 1 ELSE 0 END AS is_holiday")))
def calendar_additive_forecast(spark, sf_dir):
    """Trend, week, year and holidays: the first and the fifteenth of every month of the series."""
    spec = CALENDAR
    rows = materialise(continuous(spark, sf_dir), "continuous")
    calendar = rows.select("date").distinct().filter(F.dayofmonth("date").isin(1, 15))
    df = materialise(features.flag_dates(rows, calendar), "flagged")
    params = forecast.fit_harmonic(df, REGION, spec)
    fitted = forecast.fitted_values(df, params, REGION, spec)
    future = calendar.withColumn("is_holiday", F.lit(1))
    return rounded(
        forecast.predict_harmonic(params, fitted, REGION, STEPS, spec, model="calendar", future=future), 2, *BOUNDS
    )


@query("trained_models", "F3 F6", sql_with(ctes("nulled"), """gate AS (
    SELECT customer_id, COUNT(*) AS n_all, COUNT(*) - COUNT(value) AS n_null,
           datediff('day', MIN(date) FILTER (value IS NOT NULL), MAX(date) FILTER (value IS NOT NULL)) + 1 AS days FROM nulled
    GROUP BY customer_id),
statuses AS (
    SELECT customer_id, model, CASE WHEN n_all < 18 THEN 'too_short' WHEN n_null > n_all * 0.3 THEN 'too_many_nulls'
           ELSE CASE model WHEN 'harmonic' THEN CASE WHEN days < 14 THEN 'reduced' ELSE 'ok' END ELSE 'ok' END END AS status
    FROM gate CROSS JOIN (VALUES ('seasonal_naive'), ('mean'), ('drift'), ('autoregressive'), ('harmonic')) AS m(model))""",
    body="SELECT model, status, COUNT(*) AS n_series FROM statuses GROUP BY model, status"))
def trained_models(spark, sf_dir):
    trained = forecast.train_all(
        nulled(spark, sf_dir), KEY, spec=Harmonic(periods=(7,), harmonics=1), min_rows=18, max_null_share=0.3
    )
    return forecast.model_listing(trained)


@query("cross_validated_harmonic", "A16 F1", sql_with(ctes("cust_events"), f"""placed AS (
    SELECT *, pos // size AS fold FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date) - 1 AS pos,
               datediff('day', MIN(date) OVER (PARTITION BY customer_id), date)::DOUBLE AS t,
               COUNT(*) OVER (PARTITION BY customer_id) // 5 AS size,
               datediff('day', MIN(date) OVER (PARTITION BY customer_id), MAX(date) OVER (PARTITION BY customer_id)) + 1 AS n
        FROM cust_events)),
training AS (
    SELECT f.customer_id, f.fold, o.value, o.t, o.n
    FROM (SELECT DISTINCT customer_id, fold FROM placed WHERE fold < 5) AS f
    JOIN placed AS o ON o.customer_id = f.customer_id AND o.fold <> f.fold),
terms AS (SELECT *, {', '.join(f'{x} AS x{i}' for i, x in enumerate(design_sql(WEEK)))} FROM training)""",
    solve_sql("terms", "customer_id, fold", len(design_sql(WEEK))), f"""errors AS (
    SELECT customer_id, fold, value, ABS(value - ({' + '.join(f'b{i} * ({x})' for i, x in enumerate(design_sql(WEEK)))})) AS e
    FROM placed JOIN beta USING (customer_id, fold)),
scored AS (
    SELECT customer_id, fold, AVG(e) AS mae, SQRT(AVG(e * e)) AS rmse,
           AVG(CASE WHEN value <> 0 THEN e / ABS(value) END) * 100 AS mape FROM errors GROUP BY customer_id, fold)""", body="""
    SELECT customer_id, ROUND(AVG(mae), 4) AS mae_mean, ROUND(AVG(rmse), 4) AS rmse_mean, ROUND(AVG(mape), 4) AS mape_mean
    FROM scored GROUP BY customer_id"""))
def cross_validated_harmonic(spark, sf_dir):
    out = forecast.cross_validate_harmonic(cust_events(spark, sf_dir), KEY, Harmonic(periods=(7,)))
    return rounded(out, 4, "mae_mean", "rmse_mean", "mape_mean")


@query("held_out_rmse", "A14", sql_with(ctes("cust_events"), """parts AS (
    SELECT *, date > MAX(date) OVER (PARTITION BY customer_id) - 7 AS held FROM cust_events),
training AS (SELECT customer_id, date, value FROM parts WHERE NOT held)""", simple_sql("training", "customer_id"), body="""
    SELECT customer_id, ROUND(SQRT(AVG(POW(value - forecast, 2))), 4) AS test_rmse
    FROM parts JOIN simple USING (customer_id, date) WHERE held AND model = 'drift' GROUP BY customer_id"""))
def held_out_rmse(spark, sf_dir):
    training, test = forecast.training_window(cust_events(spark, sf_dir), 7, KEY)
    predicted = _simple(training, KEY).filter(F.col("model") == "drift")
    return forecast.test_rmse(test, predicted, KEY)


@query("forecast_run", "F3 A17 G3 P5")
def forecast_run(spark, sf_dir):
    out = forecasting.run(continuous(spark, sf_dir), REGION, STEPS)
    return rounded(out.predictions.unionByName(out.combined), 2, *BOUNDS)


@query("saved_forecaster", "IO13 F2", sql_with(ctes("event_regions"), weekdays_sql("event_regions", "region"), """spreads AS (
    SELECT region, STDDEV_POP(value - fitted) AS sd, MAX(date) AS last_date, ANY_VALUE(origin) AS origin
    FROM weekly GROUP BY region),
steps AS (SELECT CAST(unnest(generate_series(1, 7)) AS INTEGER) AS step),
ahead AS (
    SELECT *, last_date + step AS date, datediff('day', origin, last_date + step) % 7 AS phase FROM spreads CROSS JOIN steps),
means AS (SELECT region, phase, AVG(value) AS forecast FROM weekdays GROUP BY region, phase)""", body=f"""
    SELECT region, step, date, 'weekly' AS model, ROUND(forecast, 4) AS forecast,
           ROUND(forecast - {Z95} * sd, 4) AS lower_bound, ROUND(forecast + {Z95} * sd, 4) AS upper_bound
    FROM ahead JOIN means USING (region, phase)"""))
def saved_forecaster(spark, sf_dir):
    df = clean.with_min_history(event_regions(spark, sf_dir), REGION, 14)
    params = forecast.fit_harmonic(df, REGION, WEEKLY)
    path = fresh_path(spark, "forecaster")
    models.save_forecaster(params, forecast.fitted_values(df, params, REGION, WEEKLY), path)
    loaded, fitted = models.load_forecaster(spark, path, REGION)
    return rounded(forecast.predict_harmonic(loaded, fitted, REGION, STEPS, WEEKLY, model="weekly"), 4, *BOUNDS)


@query("regression_metrics", "A15", sql_with(ctes("region_daily"), naive_sql("region_daily", "region"), body="""
    SELECT region, COUNT(*) AS n_rows, ROUND(AVG(residual * residual), 2) AS mse, ROUND(AVG(ABS(residual)), 4) AS mae,
           ROUND(1 - SUM(residual * residual) / (VAR_POP(actual) * COUNT(*)), 6) AS r2,
           ROUND(SQRT(AVG(residual * residual)), 4) AS rmse FROM naive GROUP BY region"""))
def regression_metrics(spark, sf_dir):
    fitted = forecast.seasonal_naive_fit(region_daily(spark, sf_dir), REGION)
    out = residual.regression_metrics(fitted, "actual", "fitted", REGION)
    return rounded(rounded(rounded(out, 2, "mse"), 4, "mae", "rmse"), 6, "r2")


@query("aligned_features", "J5", sql_with(ctes("cust_events"), naive_sql("cust_events", "customer_id"), f"""trended AS (
    SELECT customer_id, date, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date) - 1 AS trend FROM cust_events)""",
    body=f"""SELECT customer_id, date, trend, {half_up('residual', 4)} AS residual
    FROM trended JOIN naive USING (customer_id, date)"""))
def aligned_features(spark, sf_dir):
    df = cust_events(spark, sf_dir)
    table = features.add_trend(df, KEY).select("customer_id", "date", "trend")
    return rounded(residual.align(table, forecast.seasonal_naive_fit(df, KEY), KEY), 4, "residual")


def _residual_rows(spark, sf_dir):
    """Features of the region series beside the residuals of the weekly model."""
    spec = Harmonic(periods=(7,))
    df = materialise(continuous(spark, sf_dir), "continuous")
    fitted = forecast.fitted_values(df, forecast.fit_harmonic(df, REGION, spec), REGION, spec)
    return df, fitted


@query("residual_forest_metrics", "R3 A15")
def residual_forest_metrics(spark, sf_dir):
    df, fitted = _residual_rows(spark, sf_dir)
    return rounded(forecasting.correct(df, fitted, REGION).metrics, 2, "mse", "mae", "r2", "rmse")


@query("residual_forest_importances", "S8 R3")
def residual_forest_importances(spark, sf_dir):
    df, fitted = _residual_rows(spark, sf_dir)
    return rounded(forecasting.correct(df, fitted, REGION).importances, 4, "importance")


@query("corrected_predictions", "R5 IO12")
def corrected_predictions(spark, sf_dir):
    df, fitted = _residual_rows(spark, sf_dir)
    corrected = forecasting.correct(df, fitted, REGION)
    path = fresh_path(spark, "forest")
    models.save_forest(corrected.model, path)
    table = features.feature_table(df, REGION)
    out = residual.correct(fitted, table, models.load_forest(path), REGION, "fitted")
    return rounded(out, 2, "fitted", "predicted_residual", "corrected")


@query("residual_forest_search", "R4")
def residual_forest_search(spark, sf_dir):
    """The whole grid of 36 settings over five folds, from 45 forests cut at four depths, on the series of the event regions."""
    df = materialise(fill.daily_continuity(event_regions(spark, sf_dir), REGION), "continuous")
    fitted = forecast.seasonal_naive_fit(df, REGION)
    table = features.feature_table(df, REGION)
    names = features.feature_names(table, REGION)
    rows = materialise(residual.align(table, fitted, REGION), "features")
    training, test = residual.split(rows, REGION)
    best, _ = residual.search(training, names, REGION, settings=residual.ForestSettings(partitions=1))
    return rounded(residual.train_and_test_metrics(best, training, test), 2, "mse", "mae", "r2", "rmse")


# One tree on the day of the week that sees every row once is the mean residual of each weekday, which SQL can say.
ONE_TREE = residual.ForestSettings(trees=1, bootstrap=False)


def _share_sql(salt: str) -> str:
    return f"('0x' || substr(md5('{salt}|' || region || '|' || CAST(date AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0"


WEEKDAY_TREE = f"""residuals AS (
    SELECT region, date, actual, fitted, residual, isodow(date) AS weekday, {_share_sql('split')} < 0.2 AS held FROM naive),
by_weekday AS (SELECT weekday, AVG(residual) AS predicted FROM residuals WHERE NOT held GROUP BY weekday),
weekday_tree AS (SELECT * FROM residuals JOIN by_weekday USING (weekday))"""


def tree_metrics_sql(src: str) -> str:
    return f"""SELECT CASE WHEN held THEN 'test' ELSE 'train' END AS part, COUNT(*) AS n_rows,
        ROUND(AVG(POW(residual - predicted, 2)), 2) AS mse, ROUND(AVG(ABS(residual - predicted)), 2) AS mae,
        ROUND(1 - SUM(POW(residual - predicted, 2)) / (VAR_POP(residual) * COUNT(*)), 6) AS r2,
        ROUND(SQRT(AVG(POW(residual - predicted, 2))), 4) AS rmse FROM {src} GROUP BY 1"""


def _weekday_rows(spark, sf_dir):
    """The seasonal model's residuals beside the day of the week and a constant."""
    fitted = materialise(forecast.seasonal_naive_fit(region_daily(spark, sf_dir), REGION), "naive")
    table = fitted.select(*REGION, "date", F.weekday("date").alias("day_of_week"), F.lit(1).alias("constant"))
    return fitted, table, materialise(residual.align(table, fitted, REGION), "features")


def _weekday_tree(spark, sf_dir):
    fitted, table, rows = _weekday_rows(spark, sf_dir)
    training, test = residual.split(rows, REGION)
    return fitted, table, training, test, residual.train(training, ["day_of_week", "constant"], ONE_TREE, key=REGION)


def _rounded_metrics(metrics):
    return rounded(rounded(rounded(metrics, 2, "mse", "mae"), 6, "r2"), 4, "rmse")


@query("weekday_tree_metrics", "R3 A15", sql_with(
    ctes("region_daily"), naive_sql("region_daily", "region"), WEEKDAY_TREE, body=tree_metrics_sql("weekday_tree")))
def weekday_tree_metrics(spark, sf_dir):
    _, _, training, test, model = _weekday_tree(spark, sf_dir)
    return _rounded_metrics(residual.train_and_test_metrics(model, training, test))


@query("weekday_tree_importances", "S8 R3", sql_with(
    ctes("region_daily"), naive_sql("region_daily", "region"), WEEKDAY_TREE, body="""
    SELECT 'day_of_week' AS feature, CAST(CASE WHEN COUNT(*) > 1 THEN 1 ELSE 0 END AS DOUBLE) AS importance FROM by_weekday
    UNION ALL SELECT 'constant', CAST(0 AS DOUBLE)"""))
def weekday_tree_importances(spark, sf_dir):
    _, _, training, _, model = _weekday_tree(spark, sf_dir)
    return rounded(residual.importances(model, training), 6, "importance")


@query("weekday_tree_corrections", "R5 IO12", sql_with(
    ctes("region_daily"), naive_sql("region_daily", "region"), WEEKDAY_TREE, body="""
    SELECT region, date, fitted, ROUND(predicted, 4) AS predicted_residual, ROUND(fitted + predicted, 4) AS corrected
    FROM weekday_tree"""))
def weekday_tree_corrections(spark, sf_dir):
    fitted, table, _, _, model = _weekday_tree(spark, sf_dir)
    path = fresh_path(spark, "forest")
    models.save_forest(model, path)
    out = residual.correct(fitted, table, models.load_forest(path), REGION, "fitted")
    return rounded(out, 4, "predicted_residual", "corrected")


@query("weekday_tree_search", "R4", sql_with(
    ctes("region_daily"), naive_sql("region_daily", "region"), WEEKDAY_TREE, f"""folds AS (
    SELECT *, CAST(FLOOR({_share_sql('fold')} * 5) AS INTEGER) AS fold FROM residuals WHERE NOT held),
others AS (
    SELECT f.n AS fold, weekday, AVG(residual) AS by_day, ANY_VALUE(mean) AS mean
    FROM range(5) AS f(n) JOIN folds ON folds.fold <> f.n
    JOIN (SELECT g.n AS fold_out, AVG(residual) AS mean FROM range(5) AS g(n) JOIN folds ON folds.fold <> g.n GROUP BY 1) AS m
        ON m.fold_out = f.n
    GROUP BY f.n, weekday),
errors AS (
    SELECT AVG(flat) AS flat, AVG(deep) AS deep FROM (
        SELECT fold, AVG(POW(residual - mean, 2)) AS flat, AVG(POW(residual - by_day, 2)) AS deep
        FROM folds JOIN others USING (fold, weekday) GROUP BY fold)),
chosen AS (
    SELECT t.* EXCLUDE (predicted), CASE WHEN e.deep < e.flat THEN t.predicted
           ELSE (SELECT AVG(residual) FROM residuals WHERE NOT held) END AS predicted
    FROM weekday_tree AS t, errors AS e)""", body=tree_metrics_sql("chosen")))
def weekday_tree_search(spark, sf_dir):
    """A tree of no depth, the plain mean, against one that tells the weekdays apart."""
    _, _, rows = _weekday_rows(spark, sf_dir)
    training, test = residual.split(rows, REGION)
    grid = {"maxDepth": (0, 10)}
    best, _ = residual.search(training, ["day_of_week", "constant"], REGION, grid, settings=ONE_TREE)
    return _rounded_metrics(residual.train_and_test_metrics(best, training, test))


@query("modellable_orders", "P5 G3", sql_with(ctes("cust_orders"), body="""
    SELECT customer_id, region, date, value FROM (
        SELECT *, COUNT(*) OVER (PARTITION BY customer_id) AS n FROM cust_orders) WHERE n >= 12"""))
def modellable_orders(spark, sf_dir):
    return fill.interpolate_or_mean(clean.modellable(cust_orders(spark, sf_dir), KEY, min_rows=12), KEY, "value")


def lagged_sql(src: str, key: str, column: str, lags) -> str:
    """``src`` with the column's values of that many rows ago."""
    return ", ".join(f"LAG({column}, {k}) OVER (PARTITION BY {key} ORDER BY date) AS {column}_{k}" for k in lags)


def autocorrelated_sql(order: int) -> str:
    """CTEs from ``continuous`` to ``lines`` (region, f1, f2, level, slope): a straight line whose errors follow an autoregression."""
    f = [f"f{k}" for k in range(1, order + 1)]
    late = lambda c: c + "".join(f" - {x} * {c}_{k}" for k, x in enumerate(f, 1))
    phi = {1: "r1 / r0 AS f1, 0 AS f2", 2: "r1 * (r0 - r2) / (r0 * r0 - r1 * r1) AS f1, (r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1) AS f2"}[order]
    cov = ", ".join(f"SUM((v - a - b * t) * (v{f'_{k}' if k else ''} - a - b * t{f'_{k}' if k else ''})) AS r{k}" for k in range(order + 1))
    return f"""timed AS (
    SELECT region, date, value AS v, datediff('day', MIN(date) OVER (PARTITION BY region), date) / 1000.0::DOUBLE AS t FROM continuous),
lags AS (SELECT *, {lagged_sql('timed', 'region', 'v', range(1, order + 1))}, {lagged_sql('timed', 'region', 't', range(1, order + 1))} FROM timed),
late AS (SELECT * FROM lags WHERE v_{order} IS NOT NULL),
first AS (SELECT region, REGR_INTERCEPT(v, t) AS a, REGR_SLOPE(v, t) AS b FROM late GROUP BY region),
covariances AS (SELECT region, {cov} FROM late JOIN first USING (region) GROUP BY region),
phis AS (SELECT region, {phi} FROM covariances),
less AS (SELECT region, date, {late('v')} AS y, {late('t')} AS x, f1, f2 FROM late JOIN phis USING (region)),
lines AS (
    SELECT region, COUNT(*) AS n, MAX(date) AS last_date, ANY_VALUE(f1) AS f1, ANY_VALUE(f2) AS f2, REGR_SLOPE(y, x) AS slope,
           REGR_INTERCEPT(y, x) / (1 - ANY_VALUE(f1) - ANY_VALUE(f2)) AS level,
           SQRT((REGR_SYY(y, x) - POW(REGR_SXY(y, x), 2) / REGR_SXX(y, x)) / COUNT(*)) AS sigma FROM less GROUP BY region)"""


def _autocorrelated_fit(spark, sf_dir, order):
    params = errors.fit_autocorrelated(continuous(spark, sf_dir), REGION, TREND_ONLY, order)
    out = params.select("region", "n", *(F.col("phi")[k].alias(f"phi_{k + 1}") for k in range(order)), F.col("coefficients")[0].alias("level"),
                        F.col("coefficients")[1].alias("slope"), "sigma", "status")
    return rounded(rounded(out, 6, *(f"phi_{k + 1}" for k in range(order))), 2, "level", "slope", "sigma")


@query("autocorrelated_fit", "F1", sql_with(ctes("region_daily"), CONTINUOUS, autocorrelated_sql(1), body="""
    SELECT region, n, ROUND(f1, 6) AS phi_1, ROUND(level, 2) AS level, ROUND(slope, 2) AS slope, ROUND(sigma, 2) AS sigma, 'ok' AS status FROM lines"""))
def autocorrelated_fit(spark, sf_dir):
    return _autocorrelated_fit(spark, sf_dir, 1)


@query("autocorrelated_fit_two_lags", "F1", sql_with(ctes("region_daily"), CONTINUOUS, autocorrelated_sql(2), body="""
    SELECT region, n, ROUND(f1, 6) AS phi_1, ROUND(f2, 6) AS phi_2, ROUND(level, 2) AS level, ROUND(slope, 2) AS slope,
           ROUND(sigma, 2) AS sigma, 'ok' AS status FROM lines"""))
def autocorrelated_fit_two_lags(spark, sf_dir):
    return _autocorrelated_fit(spark, sf_dir, 2)


@query("autocorrelated_forecast", "F1 F2", sql_with(ctes("region_daily"), CONTINUOUS, autocorrelated_sql(1), """ends AS (
    SELECT l.*, t AS last_t, v - level - slope * t AS e FROM lines AS l JOIN timed AS d ON d.region = l.region AND d.date = l.last_date),
points AS (
    SELECT region, step, last_date + step AS date, level + slope * (last_t + step / 1000.0::DOUBLE) + POW(f1, step) * e AS forecast,
           sigma * SQRT((1 - POW(f1, 2 * step)) / (1 - f1 * f1)) AS sd
    FROM ends CROSS JOIN (SELECT CAST(unnest(generate_series(1, 14)) AS INTEGER) AS step))""", body=f"""
    SELECT region, step, date, 'autocorrelated' AS model, ROUND(forecast, 2) AS forecast,
           ROUND(forecast - {Z95} * sd, 2) AS lower_bound, ROUND(forecast + {Z95} * sd, 2) AS upper_bound FROM points"""))
def autocorrelated_forecast(spark, sf_dir):
    params = errors.fit_autocorrelated(continuous(spark, sf_dir), REGION, TREND_ONLY, 1)
    return rounded(errors.predict_autocorrelated(params, REGION, 14, TREND_ONLY), 2, *BOUNDS)


ARIMA_LAGS = (1, 7, 8)


def _recursion_sql(name: str, steps: int, w0: str, a0: str, y0: str) -> list[str]:
    """Columns ``{name}w1, {name}y1, ...`` of the differences and values ahead, written out; ``w0(k)`` and so on name those k days before."""
    out = []
    for h in range(1, steps + 1):
        w = lambda k, h=h: f"{name}w{h - k}" if k < h else w0.format(k - h)
        a = lambda k, h=h: "0" if k < h else a0.format(k - h)
        y = lambda k, h=h: f"{name}y{h - k}" if k < h else y0.format(k - h)
        terms = [f"p{i} * {w(k)}" for i, k in enumerate(ARIMA_LAGS)] + [f"q{i} * {a(k)}" for i, k in enumerate(ARIMA_LAGS)]
        out.append(f"{' + '.join(terms)} AS {name}w{h}, {name}w{h} + {y(1)} + {y(7)} - {y(8)} AS {name}y{h}")
    return out


ARIMA = ",\n".join([
    f"""differenced AS (
    SELECT region, date, value AS y, value - LAG(value, 1) OVER s - LAG(value, 7) OVER s + LAG(value, 8) OVER s AS w
    FROM continuous WINDOW s AS (PARTITION BY region ORDER BY date)),
lagged AS (SELECT *, {lagged_sql('differenced', 'region', 'w', range(1, 16))} FROM differenced),
long_rows AS (
    SELECT region, w AS value, {', '.join(f'w_{k} AS x{k - 1}' for k in range(1, 16))} FROM lagged WHERE w_15 IS NOT NULL)""",
    solve_sql("long_rows", "region", 15, "long_"),
    f"""innovations AS (
    SELECT lagged.*, w - ({' + '.join(f'b{k - 1} * w_{k}' for k in range(1, 16))}) AS a FROM lagged JOIN long_beta USING (region)),
with_innovations AS (SELECT *, {lagged_sql('innovations', 'region', 'a', range(1, 9))}, {lagged_sql('innovations', 'region', 'y', range(1, 9))} FROM innovations),
short_rows AS (
    SELECT region, w AS value, w_1 AS x0, w_7 AS x1, w_8 AS x2, a_1 AS x3, a_7 AS x4, a_8 AS x5 FROM with_innovations WHERE a_8 IS NOT NULL)""",
    solve_sql("short_rows", "region", 6, "short_"),
    """arima_errors AS (
    SELECT region, COUNT(*) AS n, SUM(POW(value - (b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3 + b4 * x4 + b5 * x5), 2)) AS sse
    FROM short_rows JOIN short_beta USING (region) GROUP BY region),
arima AS (
    SELECT region, n, b0 AS p0, b1 AS p1, b2 AS p2, b3 AS q0, b4 AS q1, b5 AS q2, SQRT(sse / n) AS sigma,
           n * LN(sse / n) + 14 AS aic, n * LN(sse / n) + 7 * LN(n) AS bic FROM arima_errors JOIN short_beta USING (region))""",
])


@query("seasonal_arima", "F4", sql_with(ctes("region_daily"), CONTINUOUS, ARIMA, body="""
    SELECT region, n, ROUND(p0, 5) AS ar_1, ROUND(p1, 5) AS ar_7, ROUND(p2, 5) AS ar_8, ROUND(q0, 5) AS ma_1, ROUND(q1, 5) AS ma_7,
           ROUND(q2, 5) AS ma_8, ROUND(sigma, 2) AS sigma, ROUND(aic, 2) AS aic, ROUND(bic, 2) AS bic FROM arima"""))
def seasonal_arima(spark, sf_dir):
    params = arima.fit_seasonal_arima(continuous(spark, sf_dir), REGION)
    names = [f"{c}_{k}" for c in ("ar", "ma") for k in ARIMA_LAGS]
    out = params.select("region", "n", *(F.col(c)[i].alias(f"{c}_{k}") for c in ("ar", "ma") for i, k in enumerate(ARIMA_LAGS)), "sigma", "aic", "bic")
    return rounded(rounded(out, 5, *names), 2, "sigma", "aic", "bic")


@query("seasonal_arima_forecast", "F4 F2", sql_with(ctes("region_daily"), CONTINUOUS, ARIMA, f"""state AS (
    SELECT * FROM with_innovations JOIN arima USING (region) QUALIFY ROW_NUMBER() OVER (PARTITION BY region ORDER BY date DESC) = 1),
named AS (SELECT *, y AS y_0, w AS w_0, a AS a_0 FROM state),
unit AS (SELECT *, {', '.join(f'{1 if k == 0 else 0}::DOUBLE AS u_{k}' for k in range(9))} FROM named),
paths AS (SELECT *, {', '.join(_recursion_sql('f', 7, 'w_{}', 'a_{}', 'y_{}') + _recursion_sql('g', 7, 'u_{}', 'u_{}', 'u_{}'))} FROM unit),
points AS (
    {' UNION ALL '.join(f"SELECT region, {h} AS step, date + {h} AS date, fy{h} AS forecast, sigma * SQRT(1{''.join(f' + gy{j} * gy{j}' for j in range(1, h))}) AS sd FROM paths" for h in range(1, 8))})""",
    body=f"""SELECT region, step, date, 'seasonal_arima' AS model, ROUND(forecast, 1) AS forecast,
           ROUND(forecast - {Z95} * sd, 1) AS lower_bound, ROUND(forecast + {Z95} * sd, 1) AS upper_bound FROM points"""))
def seasonal_arima_forecast(spark, sf_dir):
    params = arima.fit_seasonal_arima(continuous(spark, sf_dir), REGION)
    return rounded(arima.predict_seasonal_arima(params, REGION, STEPS), 1, *BOUNDS)


@query("compared_models", "F6 A16", sql_with(ctes("cust_events"), """statuses AS (
    SELECT customer_id, model, CASE WHEN n < 18 THEN 'too_short' WHEN model = 'harmonic' AND days < 14 THEN 'reduced' ELSE 'ok' END AS status
    FROM (SELECT customer_id, COUNT(*) AS n, datediff('day', MIN(date), MAX(date)) + 1 AS days FROM cust_events GROUP BY customer_id)
    CROSS JOIN (VALUES ('seasonal_naive'), ('mean'), ('drift'), ('autoregressive'), ('harmonic')) AS m(model)),
placed AS (
    SELECT *, pos // size AS fold FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date) - 1 AS pos,
               datediff('day', MIN(date) OVER (PARTITION BY customer_id), date)::DOUBLE AS t,
               COUNT(*) OVER (PARTITION BY customer_id) // 5 AS size,
               datediff('day', MIN(date) OVER (PARTITION BY customer_id), MAX(date) OVER (PARTITION BY customer_id)) + 1 AS n
        FROM cust_events)),
training AS (
    SELECT f.customer_id, f.fold, o.value, o.t, o.n
    FROM (SELECT DISTINCT customer_id, fold FROM placed WHERE fold < 5) AS f
    JOIN placed AS o ON o.customer_id = f.customer_id AND o.fold <> f.fold),
means AS (SELECT customer_id, fold, AVG(value) AS mean FROM training GROUP BY customer_id, fold),""" + f"""
terms AS (SELECT *, {', '.join(f'{x} AS x{i}' for i, x in enumerate(design_sql(WEEK)))} FROM training)""",
    solve_sql("terms", "customer_id, fold", len(design_sql(WEEK))), f"""errors AS (
    SELECT customer_id, fold, 'harmonic' AS model, value, ABS(value - ({' + '.join(f'b{i} * ({x})' for i, x in enumerate(design_sql(WEEK)))})) AS e
    FROM placed JOIN beta USING (customer_id, fold)
    UNION ALL SELECT customer_id, fold, 'mean', value, ABS(value - mean) FROM placed JOIN means USING (customer_id, fold)),
scored AS (
    SELECT customer_id, fold, model, AVG(e) AS mae, SQRT(AVG(e * e)) AS rmse,
           AVG(CASE WHEN value <> 0 THEN e / ABS(value) END) * 100 AS mape FROM errors GROUP BY customer_id, fold, model),
scores AS (
    SELECT customer_id, model, AVG(mae) AS mae_mean, AVG(rmse) AS rmse_mean, AVG(mape) AS mape_mean FROM scored GROUP BY customer_id, model),
listed AS (
    SELECT s.customer_id, s.model, s.status, CASE WHEN status <> 'too_short' THEN mae_mean END AS mae_mean,
           CASE WHEN status <> 'too_short' THEN rmse_mean END AS rmse_mean, CASE WHEN status <> 'too_short' THEN mape_mean END AS mape_mean
    FROM statuses AS s LEFT JOIN scores AS c ON c.customer_id = s.customer_id AND c.model = s.model)""", body="""
    SELECT customer_id, model, status, ROUND(mae_mean, 4) AS mae_mean, ROUND(rmse_mean, 4) AS rmse_mean, ROUND(mape_mean, 4) AS mape_mean,
           CASE WHEN rmse_mean IS NOT NULL
                THEN ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY rmse_mean NULLS LAST, model)::INTEGER END AS rank FROM listed"""))
def compared_models(spark, sf_dir):
    """The listing of the trained models with the metrics of their cross-validation."""
    df = cust_events(spark, sf_dir)
    trained = forecast.train_all(df, KEY, spec=WEEK, min_rows=18)
    out = forecast.model_comparison(trained, forecast.cross_validated(df, KEY, WEEK), KEY)
    return rounded(out, 4, "mae_mean", "rmse_mean", "mape_mean")


CHOICE = choice.Candidates(periods=(7,), harmonics=(1, 2), dampings=(0.0, 0.9, 1.0))


def selection_sql(src: str, key: str, candidates: choice.Candidates) -> str:
    """CTEs to ``chosen``: of every candidate its regression by elimination, its error and AIC, and the smallest of each series."""
    trends, waves = candidates.trends(), candidates.waves()
    columns = ["1.0::DOUBLE", *("t / 1000.0::DOUBLE" if d == 1 else f"(1 - POW({d}::DOUBLE, t)) * ({d}::DOUBLE / {1 - d:.12g}::DOUBLE)" for d in trends)]
    columns += [f"{wave}(t * (2 * pi() * {h} / {p}))" for p, h in waves for wave in ("sin", "cos")]
    out = [f"""timed AS (
    SELECT {key}, value, datediff('day', MIN(date) OVER s, date)::DOUBLE AS t, COUNT(*) OVER s AS n FROM {src} WINDOW s AS (PARTITION BY {key}))"""]
    found = []
    for k, (d, h, own) in enumerate(candidates.each()):
        out.append(f"c{k}_rows AS (SELECT {key}, value, n, {', '.join(f'{columns[c]} AS x{i}' for i, c in enumerate(own))} FROM timed WHERE n > {len(own)})")
        out.append(solve_sql(f"c{k}_rows", key, len(own), f"c{k}_"))
        total = " + ".join(f"b{i} * x{i}" for i in range(len(own)))
        found.append(f"""SELECT {key}, {k} AS c, {d}::DOUBLE AS damping, {h} AS harmonics, {len(own)} AS n_terms, ANY_VALUE(n) AS n,
        SUM(POW(value - ({total}), 2)) AS sse FROM c{k}_rows JOIN c{k}_beta USING ({key}) GROUP BY {key}""")
    out.append(f"found AS ({' UNION ALL '.join(found)})")
    out.append(f"""chosen AS (
    SELECT *, n * LN(sse / n) + 2 * n_terms AS aic FROM found QUALIFY ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY n * LN(sse / n) + 2 * n_terms, c) = 1)""")
    return ",\n".join(out)


@query("selected_harmonic", "F1 F7", sql_with(ctes("cust_events"), "long_series AS (SELECT * FROM cust_events QUALIFY COUNT(*) OVER (PARTITION BY customer_id) >= 20)",
                                              selection_sql("long_series", "customer_id", CHOICE), body="""
    SELECT customer_id, n, damping, harmonics::INTEGER AS harmonics, n_terms::INTEGER AS n_terms, ROUND(sse, 2) AS sse, ROUND(aic, 4) AS aic, 'ok' AS status FROM chosen"""))
def selected_harmonic(spark, sf_dir):
    """Trend and harmonics of each customer's series by AIC."""
    params = choice.select_harmonic(clean.with_min_history(cust_events(spark, sf_dir), KEY, 20), KEY, CHOICE)
    out = params.select("customer_id", "n", "damping", "harmonics", "n_terms", "sse", "aic", "status")
    return rounded(rounded(out, 4, "aic"), 2, "sse")


SERIES_TREE = series_forest.SeriesForest(trees=1, depth=6, bootstrap=False, least_rows=1)


def _series_tree(spark, sf_dir):
    fitted, table, rows = _weekday_rows(spark, sf_dir)
    return fitted, table, series_forest.fit(rows, REGION, ["day_of_week"], "residual", SERIES_TREE)


@query("series_tree_corrections", "R3 R5", sql_with(ctes("region_daily"), naive_sql("region_daily", "region"), body="""
    SELECT region, date, fitted, ROUND(AVG(residual) OVER d, 2) AS predicted_residual, ROUND(fitted + AVG(residual) OVER d, 2) AS corrected
    FROM naive WINDOW d AS (PARTITION BY region, isodow(date))"""))
def series_tree_corrections(spark, sf_dir):
    """A tree for each region: on the day of the week alone, deep enough, it is the mean of the region's weekday."""
    fitted, table, model = _series_tree(spark, sf_dir)
    out = series_forest.correct(fitted, table, model, REGION, ["day_of_week"], SERIES_TREE)
    return rounded(out, 2, "predicted_residual", "corrected")


@query("series_tree_leaves", "R3", sql_with(ctes("region_daily"), naive_sql("region_daily", "region"), body="""
    SELECT region, COUNT(*)::DOUBLE AS n, ROUND(AVG(residual), 2) AS value FROM naive GROUP BY region, isodow(date)"""))
def series_tree_leaves(spark, sf_dir):
    _, _, model = _series_tree(spark, sf_dir)
    return rounded(model.filter("value is not null").select("region", "n", "value"), 2, "value")
