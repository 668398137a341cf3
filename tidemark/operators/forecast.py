"""Forecasts of many daily series: fitting, prediction with intervals, evaluation, ensembles.

Inputs are canonical daily series without nulls in the value (see ``fill``). Models are
parameters per series; fitted values and forecasts are column expressions over them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import half_up, normal_quantile, ratio
from ..storage import ship

MODELS = ("seasonal_naive", "mean", "drift", "autoregressive")

# Weight of a model that is given none.
DEFAULT_WEIGHT = 0.25


@dataclass(frozen=True)
class Harmonic:
    """Trend and seasons as a linear regression: Fourier pairs per period, plain or damped trend."""

    periods: tuple[float, ...] = (7, 365)
    harmonics: int = 2
    use_trend: bool = True
    use_damped_trend: bool = False
    damping: float = 0.98
    regressors: tuple[str, ...] = ()
    full_periods: float = 2.0  # a season is used if the series spans so many of its periods, from first to last day

    def terms(self) -> list[tuple[str, float | None]]:
        """(name, period) of each coefficient, period None for those that hold for any length."""
        out: list[tuple[str, float | None]] = [("intercept", None)]
        if self.use_trend:
            out.append(("trend", None))
        for p in self.periods:
            # Above half the period a harmonic repeats a lower one.
            for h in range(1, min(self.harmonics, math.ceil(p / 2) - 1) + 1):
                out += [(f"sin_{p:g}_{h}", p), (f"cos_{p:g}_{h}", p)]
        return out + [(r, None) for r in self.regressors]

    def design(self, t: Column) -> list[Column]:
        """The value of each term at day ``t`` of the series."""
        out = [F.lit(1.0)]
        if self.use_trend:
            if self.use_damped_trend:
                out.append((1 - F.pow(F.lit(self.damping), t)) * (self.damping / (1 - self.damping)))
            else:
                out.append(t / 1000.0)
        for p in self.periods:
            for h in range(1, min(self.harmonics, math.ceil(p / 2) - 1) + 1):
                angle = t * (2 * math.pi * h / p)
                out += [F.sin(angle), F.cos(angle)]
        return out + [F.col(r).cast("double") for r in self.regressors]


def solve(xtx: np.ndarray, xty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a stack of normal equations, and which of them have full rank."""
    scale = np.sqrt(np.maximum(np.einsum("kii->ki", xtx), 1e-300))
    unit = xtx / scale[:, :, None] / scale[:, None, :]
    rank_ok = np.linalg.eigvalsh(unit)[:, 0] > 1e-12
    solved = np.einsum("kij,kj->ki", np.linalg.pinv(unit, rcond=1e-12, hermitian=True), xty / scale)
    return solved / scale, rank_ok


def usable_terms(spec: Harmonic, days: np.ndarray) -> np.ndarray:
    """Which terms series of so many days from first to last have: the seasons of which they span enough periods."""
    return np.array([[p is None or span >= spec.full_periods * p for _, p in spec.terms()] for span in days]).reshape(len(days), -1)


def _moments(df: DataFrame, group: Sequence[str], spec: Harmonic, value: str, date: str) -> DataFrame:
    """The normal equations of each group as arrays: sums of products, combined before the shuffle."""
    terms = spec.design(F.datediff(date, "_origin").cast("double"))
    names = [f"_x{i}" for i in range(len(terms))]
    rows = df.select(*group, date, F.col(value).cast("double").alias("_y"), "_origin", *[
        x.alias(n) for x, n in zip(terms, names)
    ])
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy(*group, "_origin").agg(
        F.count("*").alias("n"), F.max(date).alias("last_date"),
        F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in upper]).alias("xtx"),
        F.array(*[F.sum(F.col(n) * F.col("_y")) for n in names]).alias("xty"),
    )


def _coefficients(moments: DataFrame, group: Sequence[str], spec: Harmonic) -> DataFrame:
    """Solve the small system of every group; whole Arrow batches of groups at a time."""
    width = len(spec.terms())
    rows, cols = np.triu_indices(width)
    schema = T.StructType([
        *[moments.schema[g] for g in group],
        T.StructField("origin", T.DateType()), T.StructField("last_date", T.DateType()),
        T.StructField("n", T.LongType()), T.StructField("n_terms", T.IntegerType()),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("status", T.StringType()),
    ])
    order = [f.name for f in schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            n = batch["n"].to_numpy()
            xtx = np.zeros((len(batch), width, width))
            xtx[:, rows, cols] = np.stack(batch["xtx"].to_numpy())
            xtx[:, cols, rows] = xtx[:, rows, cols]
            xty = np.stack(batch["xty"].to_numpy())
            days = (pd.to_datetime(batch["last_date"]) - pd.to_datetime(batch["_origin"])).dt.days + 1
            usable = usable_terms(spec, days.to_numpy())
            beta = np.zeros((len(batch), width))
            full = np.zeros(len(batch), dtype=bool)
            for mask in np.unique(usable, axis=0):
                at = np.flatnonzero((usable == mask).all(axis=1))
                on = np.flatnonzero(mask)
                beta[np.ix_(at, on)], full[at] = solve(xtx[np.ix_(at, on, on)], xty[np.ix_(at, on)])
            n_terms = usable.sum(axis=1)
            status = np.where(n < 2, "too_short", np.where(~full, "rank_deficient",
                              np.where(n_terms < width, "reduced", "ok")))
            yield batch.rename(columns={"_origin": "origin"}).assign(
                n_terms=n_terms.astype("int32"), coefficients=list(beta), status=status
            )[order]

    ship(moments.sparkSession)
    return moments.mapInPandas(run, schema)


def with_origin(df: DataFrame, key: Sequence[str], date: str) -> DataFrame:
    return df.withColumn("_origin", F.min(date).over(W.partitionBy(*key)))


def fit_harmonic(
    df: DataFrame, key: Sequence[str], spec: Harmonic = Harmonic(), value: str = "value", date: str = "date",
) -> DataFrame:
    """Parameters per series: ``origin, last_date, n, n_terms, coefficients, status``.

    A rank-deficient system (too few rows, a constant regressor) gets its least-norm solution
    and says so in ``status``; it does not fail the other series. A season is used if the series
    spans ``spec.full_periods`` of its periods from first to last day, however many days of them are there.
    """
    known = df.filter(F.col(value).isNotNull() & F.col(date).isNotNull())
    return _coefficients(_moments(with_origin(known, key, date), key, spec, value, date), key, spec)


def predicted(spec: Harmonic, date: Column) -> Column:
    t = F.datediff(date, F.col("origin")).cast("double")
    return sum((F.col("coefficients")[i] * x for i, x in enumerate(spec.design(t))), F.lit(0.0))


def fitted_values(
    df: DataFrame, params: DataFrame, key: Sequence[str], spec: Harmonic = Harmonic(), value: str = "value",
    date: str = "date",
) -> DataFrame:
    """``key, date, actual, fitted, residual`` of every training row."""
    joined = df.filter(F.col(value).isNotNull()).join(params.select(*key, "origin", "coefficients"), list(key))
    return joined.select(
        *key, date, F.col(value).alias("actual"), predicted(spec, F.col(date)).alias("fitted")
    ).withColumn("residual", F.col("actual") - F.col("fitted"))


def predict_harmonic(
    params: DataFrame, fitted: DataFrame, key: Sequence[str], steps: int, spec: Harmonic = Harmonic(),
    confidence: float = 0.95, model: str = "harmonic", future: DataFrame | None = None,
) -> DataFrame:
    """``steps`` days after the last training day, with normal bounds from the residuals.

    ``future`` holds the values of the regressors by date where the model has any.
    """
    spread = fitted.groupBy(*key).agg(F.stddev_pop("residual").alias("sd"))
    ahead = params.join(spread, list(key)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    ahead = ahead.withColumn("date", F.date_add("last_date", F.col("step")))
    point = with_future(ahead, spec, future).withColumn("forecast", predicted(spec, F.col("date")))
    return with_interval(point, confidence).select(
        *key, "step", "date", F.lit(model).alias("model"), "forecast", "lower_bound", "upper_bound"
    )


def with_future(ahead: DataFrame, spec: Harmonic, future: DataFrame | None) -> DataFrame:
    """The regressors of the days ahead, from a table with a row per date; 0 where it says nothing."""
    if not spec.regressors:
        return ahead
    if future is None:
        return ahead.withColumns({r: F.lit(0) for r in spec.regressors})
    by_date = future.groupBy("date").agg(*[F.max(r).alias(r) for r in spec.regressors])
    return ahead.join(by_date, "date", "left").withColumns({r: F.coalesce(r, F.lit(0)) for r in spec.regressors})


def with_interval(df: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Bounds at ``forecast`` plus and minus the normal quantile times ``sd``."""
    z = normal_quantile(confidence)
    return df.withColumn("lower_bound", F.col("forecast") - z * F.col("sd")).withColumn(
        "upper_bound", F.col("forecast") + z * F.col("sd")
    )


def seasonal_naive_fit(
    df: DataFrame, key: Sequence[str], value: str = "value", season: int = 7, date: str = "date",
) -> DataFrame:
    """``key, date, actual, fitted, residual`` where the value one season earlier is the fit."""
    earlier = F.lag(value, season).over(W.partitionBy(*key).orderBy(date))
    return (
        df.withColumn("fitted", earlier).filter(F.col("fitted").isNotNull())
        .select(*key, date, F.col(value).alias("actual"), "fitted",
                (F.col(value) - F.col("fitted")).alias("residual"))
    )


def fit_simple(
    df: DataFrame, key: Sequence[str], value: str = "value", season: int = 7, date: str = "date",
) -> DataFrame:
    """State per series of the mean, seasonal-naive, drift and autoregressive models.

    The autoregressive model regresses the daily difference on the one before. All windows
    and the aggregate share one shuffle by key.
    """
    w = W.partitionBy(*key).orderBy(date)
    steps = df.select(*key, date, F.col(value).alias("v")).withColumns({
        "pos": F.row_number().over(w), "from_end": F.row_number().over(W.partitionBy(*key).orderBy(F.col(date).desc())),
        "season_ago": F.lag("v", season).over(w), "diff": F.col("v") - F.lag("v", 1).over(w),
    })
    steps = steps.withColumn("diff_ago", F.lag("diff", 1).over(w))
    stats = steps.groupBy(*key).agg(
        F.count("*").alias("n"), F.max(date).alias("last_date"),
        F.min_by("v", "pos").alias("first_value"), F.max_by("v", "pos").alias("last_value"),
        F.max_by("diff", "pos").alias("last_diff"),
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("mean_sd"),
        F.array_sort(F.collect_list(F.when(F.col("from_end") <= season, F.struct("pos", "v")))).getField("v")
        .alias("last_season"),
        F.stddev_pop(F.col("v") - F.col("season_ago")).alias("seasonal_naive_sd"),
        F.stddev_pop("diff").alias("drift_sd"),
        F.regr_slope("diff", "diff_ago").alias("slope"), F.regr_intercept("diff", "diff_ago").alias("level"),
        F.avg("diff").alias("mean_diff"),
        F.sqrt(F.try_divide(F.regr_syy("diff", "diff_ago") - F.try_divide(
            F.pow(F.regr_sxy("diff", "diff_ago"), 2), F.regr_sxx("diff", "diff_ago")),
            F.regr_count("diff", "diff_ago"))).alias("autoregressive_sd"),
    )
    return stats.withColumn("drift", F.col("mean_diff")).drop("mean_diff")


def predict_simple(
    state: DataFrame, key: Sequence[str], steps: int, confidence: float = 0.95, season: int = 7,
    models: Sequence[str] = MODELS,
) -> DataFrame:
    """Forecasts of the simple models, long: one row per series, model and step.

    A model whose state is missing (a series too short for it) gives no rows.
    """
    h = F.col("step").cast("double")
    # Differences d follow d' = level + slope * d; their sum over h steps has a closed form.
    rest = F.col("level") / (1 - F.col("slope"))
    decay = F.col("slope") * (1 - F.pow("slope", h)) / (1 - F.col("slope"))
    points = {
        "seasonal_naive": F.when(F.col("n") > season, F.get("last_season", (F.col("step") - 1) % season)),
        "mean": F.col("mean"),
        "drift": F.col("last_value") + h * F.col("drift"),
        "autoregressive": F.when(
            F.col("slope") != 1, F.col("last_value") + h * rest + (F.col("last_diff") - rest) * decay
        ),
    }
    ahead = state.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    long = ahead.select(*key, "step", F.date_add("last_date", F.col("step")).alias("date"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), points[m].alias("forecast"), F.col(f"{m}_sd").alias("sd")) for m in models
    ]))).filter(F.col("forecast").isNotNull())
    return with_interval(long, confidence).drop("sd")


def train_all(
    df: DataFrame, key: Sequence[str], value: str = "value", spec: Harmonic = Harmonic(), min_rows: int = 30,
    max_null_share: float = 0.1, date: str = "date",
) -> DataFrame:
    """One row per series and model with a status; a series no model fits does not stop the others."""
    from .clean import modelling_gate

    gate = modelling_gate(df, key, value, min_rows, max_null_share).select(*key, "reason")
    state = fit_simple(df.filter(F.col(value).isNotNull()), key, value, date=date)
    checks = {
        "seasonal_naive": F.col("seasonal_naive_sd").isNotNull(), "mean": F.col("mean").isNotNull(),
        "drift": F.col("drift").isNotNull(), "autoregressive": F.col("autoregressive_sd").isNotNull(),
    }
    simple = state.select(*key, F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.when(ok, "ok").otherwise("too_short").alias("status"))
        for m, ok in checks.items()
    ])))
    harmonic = fit_harmonic(df, key, spec, value, date).select(*key, F.lit("harmonic").alias("model"), "status")
    everything = simple.unionByName(harmonic).join(gate, list(key))
    return everything.select(
        *key, "model",
        F.when(F.col("reason") != "ok", F.col("reason")).otherwise(F.col("status")).alias("status"),
    )


def model_listing(trained: DataFrame) -> DataFrame:
    return trained.groupBy("model", "status").agg(F.count("*").alias("n_series"))


def model_comparison(trained: DataFrame, scores: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per series and model: its status beside its cross-validated mae_mean, rmse_mean and mape_mean, and its rank.

    ``scores`` has a row per series and model that was cross-validated (see :func:`cross_validated`); a model without
    scores, or one whose status says that it was not fitted, has none. Rank 1 is the smallest rmse_mean of the series'
    models with scores; equal ones are in order of their names.
    """
    numbers = ("mae_mean", "rmse_mean", "mape_mean")
    fitted = F.col("status").isin("ok", "reduced", "rank_deficient")
    rows = trained.join(scores.select(*key, "model", *numbers), [*key, "model"], "left")
    rows = rows.withColumns({c: F.when(fitted, F.col(c)) for c in numbers})
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.col("rmse_mean").asc_nulls_last(), "model"))
    return rows.withColumn("rank", F.when(F.col("rmse_mean").isNotNull(), place)).select(*key, "model", "status", *numbers, "rank")


def cross_validated(
    df: DataFrame, key: Sequence[str], spec: Harmonic = Harmonic(), value: str = "value", folds: int = 5, date: str = "date",
) -> DataFrame:
    """Cross-validation scores of the models that can leave rows out, the mean and the harmonic one, by series and model."""
    known = df.filter(F.col(value).isNotNull())
    mean = cross_validate_mean(known, key, value, folds, date).withColumn("model", F.lit("mean"))
    return mean.unionByName(cross_validate_harmonic(known, key, spec, value, folds, date).withColumn("model", F.lit("harmonic")))


def model_summary(fitted: DataFrame, key: Sequence[str], n_params: int | Column, spec: Harmonic | None = None) -> DataFrame:
    """Gaussian AIC and BIC, parameter count, fitted length, residual deviation, model settings."""
    stats = fitted.groupBy(*key).agg(
        F.count("*").alias("fitted_length"), F.sum(F.pow("residual", F.lit(2))).alias("_sse"),
        F.stddev_pop("residual").alias("residual_std"),
        F.max(F.lit(n_params) if isinstance(n_params, int) else n_params).alias("parameters_count"),
    )
    n, k = F.col("fitted_length"), F.col("parameters_count")
    fit = n * F.ln(F.when(F.col("_sse") > 0, F.col("_sse") / n))
    out = stats.withColumn("aic", fit + 2 * k).withColumn("bic", fit + k * F.ln(n)).drop("_sse")
    if spec is not None:
        out = out.withColumns({
            "seasonal_periods": F.lit(",".join(f"{p:g}" for p in spec.periods)),
            "use_trend": F.lit(spec.use_trend), "use_damped_trend": F.lit(spec.use_damped_trend),
        })
    return out


def fit_metrics(fitted: DataFrame, key: Sequence[str]) -> DataFrame:
    """mse, rmse, mae, mape against the fitted value (zeros skipped), residual mean and deviation."""
    r = F.col("residual")
    mse = F.avg(r * r)
    return fitted.groupBy(*key).agg(
        half_up(F.sqrt(mse), 4).alias("rmse"), half_up(mse, 4).alias("mse"), half_up(F.avg(F.abs(r)), 4).alias("mae"),
        half_up(F.avg(F.abs(ratio(r, F.col("fitted")))) * 100, 2).alias("mape"),
        half_up(F.stddev_pop(r), 4).alias("residual_std"), half_up(F.avg(r), 4).alias("residual_mean"),
    )


def test_rmse(test: DataFrame, forecast: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Root mean squared error of a forecast on the held-out rows it covers."""
    joined = test.join(forecast.select(*key, "date", "forecast"), [*key, "date"])
    error = F.col(value) - F.col("forecast")
    return joined.groupBy(*key).agg(half_up(F.sqrt(F.avg(error * error)), 4).alias("test_rmse"))


test_rmse.__test__ = False  # the name is not a test case


def _with_folds(df: DataFrame, key: Sequence[str], folds: int, date: str) -> DataFrame:
    """Contiguous folds of n // folds rows; the remainder at the end is in no test fold (fold = -1)."""
    series = W.partitionBy(*key)
    size = F.floor(F.count("*").over(series) / folds)
    out = df.withColumn("_pos", F.row_number().over(series.orderBy(date)) - 1).withColumn("_size", size)
    fold = F.floor(F.try_divide(F.col("_pos"), F.col("_size")))
    return out.withColumn("fold", F.when(fold < folds, fold).otherwise(-1).cast("int")).drop("_pos", "_size")


def _mean_scores(errors: DataFrame, key: Sequence[str]) -> DataFrame:
    """Scores per fold from ``_e`` and ``_actual``, then their means over the folds."""
    e = F.abs("_e")
    per_fold = errors.groupBy(*key, "fold").agg(
        F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(ratio(e, F.abs("_actual"))) * 100).alias("mape"),
    )
    return per_fold.groupBy(*key).agg(
        F.avg("mae").alias("mae_mean"), F.avg("rmse").alias("rmse_mean"), F.avg("mape").alias("mape_mean")
    )


def cross_validate_mean(
    df: DataFrame, key: Sequence[str], value: str = "value", folds: int = 5, date: str = "date",
) -> DataFrame:
    """Scores of predicting each fold by the mean of all other rows.

    That mean follows from the totals of the series and of the fold, so nothing is refitted.
    """
    rows = _with_folds(df, key, folds, date)
    series, fold = W.partitionBy(*key), W.partitionBy(*key, "fold")
    others = (F.sum(value).over(series) - F.sum(value).over(fold)) / F.nullif(
        F.count(value).over(series) - F.count(value).over(fold), F.lit(0)
    )
    errors = rows.withColumn("_e", F.col(value) - others).filter(F.col("fold") >= 0)
    return _mean_scores(errors.withColumn("_actual", F.col(value)), key)


def cross_validate_harmonic(
    df: DataFrame, key: Sequence[str], spec: Harmonic = Harmonic(), value: str = "value", folds: int = 5,
    date: str = "date",
) -> DataFrame:
    """Scores of the harmonic model refitted without each fold.

    The normal equations of "all but fold f" are those of the series minus those of the fold:
    one pass over the rows serves all refits. Held-out rows keep their dates.
    """
    rows = _with_folds(with_origin(df.filter(F.col(value).isNotNull()), key, date), key, folds, date)
    per_fold = _moments(rows, [*key, "fold"], spec, value, date)
    series = W.partitionBy(*key)
    width = len(spec.terms())

    def others(name: str, size: int) -> Column:
        return F.array(*[F.sum(F.col(name)[i]).over(series) - F.col(name)[i] for i in range(size)])

    without = per_fold.select(
        *key, "fold", "_origin", F.max("last_date").over(series).alias("last_date"),
        (F.sum("n").over(series) - F.col("n")).alias("n"),
        others("xtx", width * (width + 1) // 2).alias("xtx"), others("xty", width).alias("xty"),
    ).filter(F.col("fold") >= 0)
    params = _coefficients(without, [*key, "fold"], spec).select(*key, "fold", "origin", "coefficients")
    tested = rows.filter(F.col("fold") >= 0).join(params, [*key, "fold"])
    errors = tested.withColumn("_e", F.col(value) - predicted(spec, F.col(date))).withColumn("_actual", F.col(value))
    return _mean_scores(errors, key)


def ensemble(
    predictions: DataFrame, key: Sequence[str], weights: dict[str, float] | None = None, enabled: bool = True,
    single: str = "harmonic",
) -> DataFrame:
    """Weighted mean per series and step over the models that are there.

    Switched off, it hands through the forecasts of the ``single`` model.
    """
    if not enabled:
        return predictions.filter(F.col("model") == single)
    weight = F.lit(DEFAULT_WEIGHT)
    for model, w in (weights or {}).items():
        weight = F.when(F.col("model") == model, float(w)).otherwise(weight)
    weighted = predictions.withColumn("_w", weight)
    return weighted.groupBy(*key, "step", "date").agg(
        F.lit("ensemble").alias("model"),
        *[ratio(F.sum(F.col(c) * F.col("_w")), F.sum("_w")).alias(c)
          for c in ("forecast", "lower_bound", "upper_bound")],
    )


def residual_histogram(fitted: DataFrame, key: Sequence[str], bins: int = 30) -> DataFrame:
    """Rows per equal-width bin of each series' residuals; the last bin includes its upper edge."""
    series = W.partitionBy(*key)
    rows = fitted.filter(F.col("residual").isNotNull()).withColumns({
        "_low": F.min("residual").over(series), "_high": F.max("residual").over(series),
    })
    share = F.try_divide(F.col("residual") - F.col("_low"), F.col("_high") - F.col("_low"))
    index = F.least(F.floor(F.coalesce(share, F.lit(0.5)) * bins), F.lit(bins - 1)).cast("int")
    return rows.withColumn("bin", index).groupBy(*key, "bin").agg(F.count("*").alias("n_rows"))


def autocorrelation(fitted: DataFrame, key: Sequence[str], lags: int = 20, date: str = "date") -> DataFrame:
    """Autocorrelation of the residuals at lags 0 to ``lags``; the lagged values come from one window."""
    series = W.partitionBy(*key)
    w = series.orderBy(date)
    rows = fitted.select(*key, date, (F.col("residual") - F.avg("residual").over(series)).alias("_r"))
    rows = rows.withColumns({f"_l{k}": F.lag("_r", k).over(w) for k in range(lags + 1)})
    sums = rows.groupBy(*key).agg(*[F.sum(F.col("_r") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(lags + 1)])
    return sums.select(*key, F.posexplode(F.array(*[
        ratio(F.coalesce(f"_s{k}", F.lit(0.0)), F.col("_s0")) for k in range(lags + 1)
    ])).alias("lag", "acf"))


def training_window(df: DataFrame, days_held_out: int, key: Sequence[str], date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Rows before and within the last days of each series."""
    last = F.max(date).over(W.partitionBy(*key))
    marked = df.withColumn("_held", F.col(date) > F.date_sub(last, days_held_out))
    return marked.filter(~F.col("_held")).drop("_held"), marked.filter("_held").drop("_held")
