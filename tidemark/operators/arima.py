"""Seasonal ARIMA (1,1,1)(1,1,1,s) of many series by two regressions (Hannan and Rissanen).

The value is differenced by a day and by a season. A long autoregression estimates the innovations; then the differences
are regressed on those of 1, s and s + 1 days ago and on the innovations of the same days. Lags are windows over the
series' days, moments are sums by key, and only the small systems are solved in Python, whole Arrow batches of series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import ship
from .forecast import solve, with_interval

LONG_LAGS = 15
LEAST_ROWS = 30
STABLE = 1 - 1e-9


def regress(rows: DataFrame, group: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """``n, coefficients, sse, full_rank`` of the regression of ``y`` on ``xs`` in each group, over rows without nulls."""
    names = [*xs, y]
    known = rows.dropna(subset=names)
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    moments = known.groupBy(*group).agg(F.count("*").alias("n"), F.array(*products).alias("moments"))
    m, upper = len(xs), np.triu_indices(len(names))
    schema = T.StructType([
        *[moments.schema[g] for g in group], T.StructField("n", T.LongType()), T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("sse", T.DoubleType()), T.StructField("full_rank", T.BooleanType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            v = np.zeros((len(batch), len(names), len(names)))
            v[:, upper[0], upper[1]] = np.stack(batch["moments"].to_numpy())
            v[:, upper[1], upper[0]] = v[:, upper[0], upper[1]]
            beta, full = solve(v[:, :m, :m], v[:, :m, m])
            left = np.concatenate([-beta, np.ones((len(batch), 1))], axis=1)
            sse = np.maximum(np.einsum("ki,kij,kj->k", left, v, left), 0)
            yield batch.assign(coefficients=list(beta), sse=sse, full_rank=full)[schema.names]

    ship(rows.sparkSession)
    return moments.mapInPandas(run, schema)


def _lags(column: str, days: Sequence[int], w) -> dict[str, Column]:
    return {f"{column}_{k}": F.lag(column, k).over(w) for k in days}


def _weighted(coefficients: Column, columns: Sequence[str]) -> Column:
    return sum((F.get(coefficients, F.lit(i)) * F.col(c) for i, c in enumerate(columns)), F.lit(0.0))


def fit_seasonal_arima(
    df: DataFrame, key: Sequence[str], season: int = 7, long_lags: int = LONG_LAGS, value: str = "value", date: str = "date",
) -> DataFrame:
    """One row per series: ``last_date, n, ar, ma, sigma, aic, bic, y, w, a, status``.

    ``ar`` and ``ma`` are the coefficients at 1, ``season`` and ``season + 1`` days; ``y``, ``w`` and ``a`` the last values,
    differences and innovations, the latest first. ``n`` counts the days of the second regression. Status: ``too_short``
    (under 30 of these days, or none; no coefficients), ``rank_deficient`` (a constant series, say; least-norm
    coefficients), ``explosive`` (the autoregression has a root on or within the unit circle), ``ok``.

    Days are to be without gaps and nulls (see ``fill``): a difference or lag over a gap counts for nothing.
    """
    series = W.partitionBy(*key)
    w = series.orderBy(date)
    own = df.filter(F.col(value).isNotNull() & F.col(date).isNotNull()).select(*key, F.col(date).alias("date"), F.col(value).cast("double").alias("y"))
    own = own.withColumns({**_lags("y", range(1, season + 2), w), "_ago": F.lag("date", season + 1).over(w)})
    difference = F.col("y") - F.col("y_1") - F.col(f"y_{season}") + F.col(f"y_{season + 1}")
    own = own.withColumn("w", F.when(F.datediff("date", "_ago") == season + 1, difference))
    long = [f"w_{k}" for k in range(1, long_lags + 1)]
    own = own.withColumns(_lags("w", range(1, max(long_lags, season + 1) + 1), w))
    first = regress(own, key, long, "w").filter(F.col("n") >= 2 * long_lags).select(*key, F.col("coefficients").alias("_long"))
    rows = own.join(first, list(key), "left")
    rows = rows.withColumn("a", F.col("w") - _weighted(F.col("_long"), long))
    rows = rows.withColumns(_lags("a", range(1, season + 2), w))
    used = [f"{c}_{k}" for c in ("w", "a") for k in (1, season, season + 1)]
    second = regress(rows, key, used, "w")
    last = lambda c: F.array(F.col(c), *(F.col(f"{c}_{k}") for k in range(1, season + 2))).alias(c)
    ends = rows.groupBy(*key).agg(F.max("date").alias("last_date"), F.max_by(F.struct(last("y"), last("w"), last("a")), "date").alias("_end"))
    n, k = F.col("n"), len(used) + 1
    fit = n * F.ln(F.when(F.col("sse") > 0, F.col("sse") / n))
    whole = F.coalesce(n >= LEAST_ROWS, F.lit(False)) & ~F.exists("_end.a", lambda x: x.isNull())
    joined = ends.join(second, list(key), "left").withColumn("_whole", whole)
    when = lambda c: F.when(F.col("_whole"), c)
    out = joined.select(
        *key, "last_date", F.coalesce(n, F.lit(0)).alias("n"), when(F.slice("coefficients", 1, 3)).alias("ar"), when(F.slice("coefficients", 4, 3)).alias("ma"),
        when(F.sqrt(F.col("sse") / n)).alias("sigma"), when(fit + 2 * k).alias("aic"), when(fit + k * F.ln(n)).alias("bic"),
        *(when(F.col(f"_end.{c}")).alias(c) for c in ("y", "w", "a")), F.col("full_rank").alias("_full"),
    )
    return _with_status(out, season)


def _with_status(params: DataFrame, season: int) -> DataFrame:
    """The status from the rank and from the largest root of the autoregression."""
    schema = T.StructType([*[f for f in params.schema if f.name != "_full"], T.StructField("status", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            companion = np.zeros((len(batch), season + 1, season + 1))
            companion[:, np.arange(1, season + 1), np.arange(season)] = 1
            known = batch["ar"].notna().to_numpy()
            if known.any():
                companion[np.ix_(known, [0], [0, season - 1, season])] = np.stack(batch["ar"][known].to_numpy())[:, None, :]
            radius = np.abs(np.linalg.eigvals(companion)).max(axis=1) if len(batch) else np.zeros(0)
            full = batch["_full"].eq(True).to_numpy()
            status = np.where(~known, "too_short", np.where(~full, "rank_deficient", np.where(radius >= STABLE, "explosive", "ok")))
            yield batch.assign(status=status)[schema.names]

    return params.mapInPandas(run, schema)


def predict_seasonal_arima(
    params: DataFrame, key: Sequence[str], steps: int, season: int = 7, confidence: float = 0.95, model: str = "seasonal_arima",
) -> DataFrame:
    """``steps`` days after the last day by the recursion, with bounds from the weights of past innovations.

    Series that are ``too_short`` give no rows.
    """
    front = lambda x, xs: F.slice(F.concat(F.array(x), xs), F.lit(1), F.lit(season + 2))
    zeros = F.array(*[F.lit(0.0)] * (season + 1))
    impulse = F.concat(F.array(F.lit(1.0)), zeros)
    at_lags = (0, season - 1, season)

    def following(at: Column, y: str, w: str, a: str) -> tuple[Column, Column]:
        new_w = sum((F.get(F.col(c), F.lit(i)) * F.get(at[x], F.lit(k)) for c, x in (("ar", w), ("ma", a)) for i, k in enumerate(at_lags)), F.lit(0.0))
        return new_w + F.get(at[y], F.lit(0)) + F.get(at[y], F.lit(season - 1)) - F.get(at[y], F.lit(season)), new_w

    none = F.array().cast("array<struct<forecast:double,growth:double>>")
    start = F.struct(
        F.col("y").alias("y"), F.col("w").alias("w"), F.col("a").alias("a"), impulse.alias("py"), impulse.alias("pw"), impulse.alias("pa"),
        F.lit(1.0).alias("sum"), none.alias("out"))

    def step(at: Column, _: Column) -> Column:
        (y, w), (py, pw) = following(at, "y", "w", "a"), following(at, "py", "pw", "pa")
        return F.struct(
            front(y, at["y"]).alias("y"), front(w, at["w"]).alias("w"), front(F.lit(0.0), at["a"]).alias("a"), front(py, at["py"]).alias("py"),
            front(pw, at["pw"]).alias("pw"), front(F.lit(0.0), at["pa"]).alias("pa"), (at["sum"] + py * py).alias("sum"),
            F.concat(at["out"], F.array(F.struct(y.alias("forecast"), F.sqrt(at["sum"]).alias("growth")))).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda at: at["out"])
    ahead = params.filter(F.col("ar").isNotNull()).select("*", F.posexplode(path).alias("_at", "_path"))
    point = ahead.withColumns({"step": F.col("_at") + 1, "forecast": F.col("_path.forecast"), "sd": F.col("sigma") * F.col("_path.growth")})
    point = point.withColumn("date", F.date_add("last_date", F.col("step")))
    return with_interval(point, confidence).select(*key, "step", "date", F.lit(model).alias("model"), "forecast", "lower_bound", "upper_bound")
