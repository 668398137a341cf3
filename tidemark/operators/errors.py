"""Trend and seasons with autocorrelated errors: what is left over follows an autoregression.

One aggregate gives everything a fit needs: the sums of products of the terms, the value and the earlier values. The
value of a trend or season term ``k`` days ago is a fixed combination of today's terms, so the moments of all lagged
rows follow from those of today's. From them come, without reading the rows again, the least-squares fit, the
autocovariances of its errors, their autoregression by the Levinson-Durbin recursion, and the generalised least-squares
fit of the rows less their predicted errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import ship
from .forecast import Harmonic, predicted, solve, usable_terms, with_future, with_interval

MOST_PARTIAL = 0.99


def shifted(spec: Harmonic, days: int) -> np.ndarray:
    """The matrix that takes the terms of a day, without regressors, to those of ``days`` earlier."""
    names = [name for name, _ in spec.terms() if name not in spec.regressors]
    out = np.eye(len(names))
    for i, name in enumerate(names):
        if name == "trend" and spec.use_damped_trend:
            back = spec.damping ** -days
            out[i, i], out[i, 0] = back, (1 - back) * spec.damping / (1 - spec.damping)
        elif name == "trend":
            out[i, 0] = -days / 1000.0
        elif name.startswith("sin_"):
            _, period, h = name.split("_")
            angle = 2 * math.pi * int(h) * days / float(period)
            out[i:i + 2, i:i + 2] = [[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]]
    return out


def _terms_at(spec: Harmonic, t: np.ndarray) -> np.ndarray:
    """The terms without regressors at the days ``t``, a row for each."""
    out = []
    for name, _ in spec.terms():
        if name == "intercept":
            out.append(np.ones(len(t)))
        elif name == "trend":
            out.append((1 - spec.damping ** t) * spec.damping / (1 - spec.damping) if spec.use_damped_trend else t / 1000.0)
        elif name not in spec.regressors:
            wave, period, h = name.split("_")
            out.append(getattr(np, wave)(2 * math.pi * int(h) * t / float(period)))
    return np.stack(out, axis=1)


def levinson(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Autoregressions of every order from the autocovariances, a row of lags 0 to p for each series.

    Returns coefficients (series, order from 0 to p, lag) and innovation variances (series, order). Partial
    autocorrelations are held within 0.99, so every autoregression is stationary.
    """
    n, p = r.shape[0], r.shape[1] - 1
    phi, variance = np.zeros((n, p + 1, p)), np.zeros((n, p + 1))
    variance[:, 0] = r[:, 0]
    for m in range(1, p + 1):
        before = phi[:, m - 1, :m - 1]
        missing = r[:, m] - np.einsum("ki,ki->k", before, r[:, m - 1:0:-1])
        partial = np.divide(missing, variance[:, m - 1], out=np.zeros(n), where=variance[:, m - 1] > 0)
        partial = np.clip(partial, -MOST_PARTIAL, MOST_PARTIAL)
        phi[:, m, :m - 1] = before - partial[:, None] * before[:, ::-1]
        phi[:, m, m - 1] = partial
        variance[:, m] = variance[:, m - 1] * (1 - partial ** 2)
    return phi, variance


def _lagged_moments(df: DataFrame, key: Sequence[str], spec: Harmonic, order: int, value: str, date: str) -> DataFrame:
    """The sums of products of terms, lagged values and lagged regressors over the days with all earlier days there."""
    series = W.partitionBy(*key)
    ordered = series.orderBy(date)
    plain = Harmonic(spec.periods, spec.harmonics, spec.use_trend, spec.use_damped_trend, spec.damping)
    own = df.filter(F.col(value).isNotNull() & F.col(date).isNotNull()).withColumns({
        "_origin": F.min(date).over(series), "_last": F.max(date).over(series), "_before": F.lag(date, order).over(ordered),
    })
    carried = [value, *spec.regressors]
    lagged = {f"_l{k}_{i}": F.lag(F.col(c).cast("double"), k).over(ordered) for k in range(order + 1) for i, c in enumerate(carried)}
    terms = plain.design(F.datediff(date, "_origin").cast("double"))
    rows = own.withColumns(lagged).select(*key, date, "_origin", "_last", (F.datediff(date, "_before") == order).alias("_whole"),
                                          *lagged, *(x.alias(f"_x{i}") for i, x in enumerate(terms)))
    names = [*(f"_x{i}" for i in range(len(terms))), *lagged]
    used = lambda x: F.sum(F.when(F.col("_whole"), x))
    products = [used(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    recent = F.array(*(F.col(c) for c in lagged))
    return rows.groupBy(*key, "_origin", "_last").agg(
        F.count(F.when(F.col("_whole"), 1)).alias("n"), F.array(*products).alias("moments"),
        F.max_by(recent, F.when(F.col("_whole"), F.col(date))).alias("recent"), F.max(F.when(F.col("_whole"), F.col(date))).alias("last_date"),
    )


def _lag_maps(spec: Harmonic, on: np.ndarray, order: int) -> list[np.ndarray]:
    """For each lag the matrix from the moments' variables to the used terms and the value of that many days ago."""
    n_plain = len(spec.terms()) - len(spec.regressors)
    n_carried = 1 + len(spec.regressors)
    out = []
    for k in range(order + 1):
        full = np.zeros((len(spec.terms()) + 1, n_plain + n_carried * (order + 1)))
        full[:n_plain, :n_plain] = shifted(spec, k)
        at = n_plain + n_carried * k
        for i in range(len(spec.regressors)):
            full[n_plain + i, at + 1 + i] = 1
        full[-1, at] = 1
        out.append(full[np.append(on, len(spec.terms()))])
    return out


def fit_autocorrelated(
    df: DataFrame, key: Sequence[str], spec: Harmonic = Harmonic(), order: int = 1, choose: bool = False,
    value: str = "value", date: str = "date",
) -> DataFrame:
    """Parameters per series: ``origin, last_date, n, n_terms, coefficients, phi, sigma, recent, status``.

    ``phi`` are the coefficients of the errors' autoregression, from yesterday's on, ``sigma`` the deviation of what it
    leaves over, ``recent`` the last errors, the latest first. With ``choose`` the order up to ``order`` with the smallest
    AIC is taken for each series, and the other coefficients are 0. Days whose ``order`` days before are not all there
    count for nothing, so gaps are filled first; ``last_date`` is the last day that counts. A series without such days
    is ``too_short``; a system without full rank gets its least-norm solution and says ``rank_deficient``; ``reduced``
    says that a season is too long for the series. Null values are left out.
    """
    moments = _lagged_moments(df, key, spec, order, value, date)
    width, n_plain = len(spec.terms()), len(spec.terms()) - len(spec.regressors)
    n_carried = 1 + len(spec.regressors)
    size = n_plain + n_carried * (order + 1)
    upper = np.triu_indices(size)
    schema = T.StructType([
        *[moments.schema[g] for g in key],
        T.StructField("origin", T.DateType()), T.StructField("last_date", T.DateType()), T.StructField("n", T.LongType()),
        T.StructField("n_terms", T.IntegerType()), T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("phi", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.DoubleType()),
        T.StructField("recent", T.ArrayType(T.DoubleType())), T.StructField("status", T.StringType()),
    ])

    def fit(batch: pd.DataFrame) -> pd.DataFrame:
        n = batch["n"].to_numpy()
        whole = n > 0
        v = np.zeros((len(batch), size, size))
        last = np.zeros((len(batch), n_carried * (order + 1)))
        if whole.any():
            some = np.zeros((int(whole.sum()), size, size))
            some[:, upper[0], upper[1]] = np.stack(batch["moments"][whole].to_numpy())
            some[:, upper[1], upper[0]] = some[:, upper[0], upper[1]]
            v[whole] = some
            last[whole] = np.stack(batch["recent"][whole].to_numpy())
        origin, end = pd.to_datetime(batch["_origin"]), pd.to_datetime(batch["last_date"])
        usable = usable_terms(spec, ((pd.to_datetime(batch["_last"]) - origin).dt.days + 1).to_numpy())
        beta, phi = np.zeros((len(batch), width)), np.zeros((len(batch), order))
        sigma, recent, full = np.zeros(len(batch)), np.zeros((len(batch), order)), np.zeros(len(batch), bool)
        for mask in np.unique(usable, axis=0):
            at = np.flatnonzero((usable == mask).all(axis=1) & whole)
            if not len(at):
                continue
            on = np.flatnonzero(mask)
            maps, rows, m = _lag_maps(spec, on, order), v[at], len(on)
            own = np.einsum("ai,kij,bj->kab", maps[0], rows, maps[0])
            first, _ = solve(own[:, :m, :m], own[:, :m, m])
            left = np.concatenate([-first, np.ones((len(at), 1))], axis=1)
            lagged = np.stack([np.einsum("ka,ai,kij,bj,kb->k", left, maps[0], rows, x, left) for x in maps], axis=1) / n[at][:, None]
            every, variance = levinson(lagged)
            if choose:
                with np.errstate(divide="ignore"):
                    aic = n[at][:, None] * np.log(np.maximum(variance, 1e-300)) + 2 * np.arange(order + 1)
                taken = every[np.arange(len(at)), aic.argmin(axis=1)]
            else:
                taken = every[:, order]
            weight = np.concatenate([np.ones((len(at), 1)), -taken], axis=1)
            both = np.einsum("kl,lai->kai", weight, np.stack(maps))
            less = np.einsum("kai,kij,kbj->kab", both, rows, both)
            b, full[at] = solve(less[:, :m, :m], less[:, :m, m])
            left = np.concatenate([-b, np.ones((len(at), 1))], axis=1)
            sse = np.einsum("ka,kab,kb->k", left, less, left)
            beta[np.ix_(at, on)], phi[at], sigma[at] = b, taken, np.sqrt(np.maximum(sse, 0) / n[at])
        for k in range(order):
            t = ((end - origin).dt.days.fillna(0).to_numpy() - k).astype(float)
            own = last[:, n_carried * k:n_carried * (k + 1)]
            x = np.concatenate([_terms_at(spec, t), own[:, 1:]], axis=1)
            recent[:, k] = own[:, 0] - (x * beta).sum(axis=1)
        status = np.where(~whole, "too_short", np.where(~full, "rank_deficient", np.where(usable.all(axis=1), "ok", "reduced")))
        listed = lambda rows: [r if ok else None for r, ok in zip(rows, whole)]
        return batch[list(key)].assign(
            origin=batch["_origin"], last_date=batch["last_date"], n=n, n_terms=usable.sum(axis=1).astype("int32"), coefficients=listed(beta),
            phi=listed(phi), sigma=np.where(whole, sigma, np.nan), recent=listed(recent), status=status)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                yield fit(batch.reset_index(drop=True))[schema.names]

    ship(moments.sparkSession)
    out = moments.mapInPandas(run, schema)
    return out.withColumn("sigma", F.when(F.col("status") != "too_short", F.col("sigma")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def error_path(phi: Column, recent: Column, steps: int) -> Column:
    """An array of (e, growth) for the next ``steps`` days: the predicted error and the root of the summed squared weights.

    The error fades as the autoregression says; the uncertainty grows with each day's weight of a past innovation.
    """
    front = lambda x, xs: F.slice(F.concat(F.array(x), xs), F.lit(1), F.size(xs))
    impulse = front(F.lit(1.0), F.transform(recent, lambda _: F.lit(0.0)))
    none = F.array().cast("array<struct<e:double,growth:double>>")
    start = F.struct(recent.alias("recent"), impulse.alias("psi"), F.lit(1.0).alias("sum"), none.alias("out"))

    def step(at: Column, _: Column) -> Column:
        e, psi = _dot(phi, at["recent"]), _dot(phi, at["psi"])
        return F.struct(
            front(e, at["recent"]).alias("recent"), front(psi, at["psi"]).alias("psi"), (at["sum"] + psi * psi).alias("sum"),
            F.concat(at["out"], F.array(F.struct(e.alias("e"), F.sqrt(at["sum"]).alias("growth")))).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda at: at["out"])


def predict_autocorrelated(
    params: DataFrame, key: Sequence[str], steps: int, spec: Harmonic = Harmonic(), confidence: float = 0.95,
    model: str = "autocorrelated", future: DataFrame | None = None,
) -> DataFrame:
    """``steps`` days after the last day: terms plus the fading error, with bounds that widen as the error is forgotten.

    Series without parameters give no rows. ``future`` holds the values of the regressors by date where the model has any.
    """
    path = error_path(F.col("phi"), F.col("recent"), steps)
    ahead = params.filter(F.col("coefficients").isNotNull()).select("*", F.posexplode(path).alias("_at", "_path"))
    ahead = ahead.withColumn("step", F.col("_at") + 1).withColumn("date", F.date_add("last_date", F.col("step")))
    point = with_future(ahead, spec, future).withColumns({
        "forecast": predicted(spec, F.col("date")) + F.col("_path.e"), "sd": F.col("sigma") * F.col("_path.growth"),
    })
    return with_interval(point, confidence).select(*key, "step", "date", F.lit(model).alias("model"), "forecast", "lower_bound", "upper_bound")
