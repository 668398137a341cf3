"""The trend and the number of harmonics of each series, chosen by AIC from one aggregate.

The candidates share their terms: fewer harmonics are a part of the most, and each damping is a column of its own. So the
sums of products of all columns, taken once, hold the normal equations of every candidate; fits, errors and AIC follow
without reading the series again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import ship
from .forecast import solve, with_interval, with_origin


@dataclass(frozen=True)
class Candidates:
    """What a series may choose from. A damping of 0 is no trend, of 1 a straight one; harmonics hold for every period."""

    periods: tuple[float, ...] = (7, 365)
    harmonics: tuple[int, ...] = (1, 2, 3)
    dampings: tuple[float, ...] = (0.0, 0.9, 0.98, 1.0)
    full_periods: float = 2.0

    def waves(self) -> list[tuple[float, int]]:
        """(period, harmonic) of the most harmonics; above half a period one repeats a lower one."""
        most = max(self.harmonics, default=0)
        return [(p, h) for p in self.periods for h in range(1, min(most, math.ceil(p / 2) - 1) + 1)]

    def trends(self) -> list[float]:
        return [d for d in self.dampings if d > 0]

    def design(self, t: Column) -> list[Column]:
        """Intercept, the trends, and a sine and a cosine for each wave, at day ``t``."""
        damped = lambda d: (1 - F.pow(F.lit(d), t)) * (d / (1 - d))
        out = [F.lit(1.0), *(t / 1000.0 if d == 1 else damped(d) for d in self.trends())]
        for p, h in self.waves():
            out += [F.sin(t * (2 * math.pi * h / p)), F.cos(t * (2 * math.pi * h / p))]
        return out

    def each(self) -> list[tuple[float, int, list[int]]]:
        """(damping, harmonics, columns) of every candidate, the one with fewer columns first."""
        trends, waves = self.trends(), self.waves()
        out = []
        for d in self.dampings:
            for n in self.harmonics:
                columns = [0, *([1 + trends.index(d)] if d > 0 else [])]
                columns += [1 + len(trends) + 2 * i + k for i, (_, h) in enumerate(waves) if h <= n for k in (0, 1)]
                out.append((d, n, columns))
        return sorted(out, key=lambda c: (len(c[2]), c[0], c[1]))

    def usable(self, column: int, days: int) -> bool:
        """Whether a series of so many days from first to last has the column: seasons need enough periods."""
        wave = (column - 1 - len(self.trends())) // 2
        return wave < 0 or days >= self.full_periods * self.waves()[wave][0]


def select_harmonic(
    df: DataFrame, key: Sequence[str], candidates: Candidates = Candidates(), value: str = "value", date: str = "date",
) -> DataFrame:
    """One row per series: ``origin, last_date, n, damping, harmonics, n_terms, coefficients, sse, aic, status``.

    The candidate with the smallest AIC, n ln(sse / n) + 2 terms, is taken; of equal ones the one with fewer terms, then
    the smaller damping and fewer harmonics. ``coefficients`` has a place for every column of all candidates, 0 where the
    chosen one has none. Seasons that the series is too short for are in no candidate. A candidate whose columns depend
    on each other, or that has no row more than columns, is not taken; if none is left the mean is, and ``status`` says
    ``too_short``. A series that a candidate fits without error takes the first such one. Null values are left out.
    """
    known = df.filter(F.col(value).isNotNull() & F.col(date).isNotNull())
    rows = with_origin(known, key, date)
    columns = [*candidates.design(F.datediff(date, "_origin").cast("double")), F.col(value).cast("double")]
    names = [f"_x{i}" for i in range(len(columns))]
    wide = rows.select(*key, date, "_origin", *(c.alias(n) for c, n in zip(columns, names)))
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    moments = wide.groupBy(*key, "_origin").agg(F.count("*").alias("n"), F.max(date).alias("last_date"), F.array(*products).alias("moments"))
    size = len(names)
    upper = np.triu_indices(size)
    schema = T.StructType([
        *[moments.schema[g] for g in key],
        T.StructField("origin", T.DateType()), T.StructField("last_date", T.DateType()), T.StructField("n", T.LongType()),
        T.StructField("damping", T.DoubleType()), T.StructField("harmonics", T.IntegerType()), T.StructField("n_terms", T.IntegerType()),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("sse", T.DoubleType()), T.StructField("aic", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ])

    def choose(batch: pd.DataFrame) -> pd.DataFrame:
        n = batch["n"].to_numpy()
        v = np.zeros((len(batch), size, size))
        v[:, upper[0], upper[1]] = np.stack(batch["moments"].to_numpy())
        v[:, upper[1], upper[0]] = v[:, upper[0], upper[1]]
        days = ((pd.to_datetime(batch["last_date"]) - pd.to_datetime(batch["_origin"])).dt.days + 1).to_numpy()
        mean = v[:, 0, -1] / n
        beta = np.zeros((len(batch), size - 1))
        beta[:, 0] = mean
        sse = np.maximum(v[:, -1, -1] - mean * v[:, 0, -1], 0)
        best = np.full(len(batch), np.inf)
        damping, harmonics, terms = np.zeros(len(batch)), np.zeros(len(batch), int), np.ones(len(batch), int)
        for d, h, own in candidates.each():
            usable = np.array([[candidates.usable(c, span) for c in own] for span in days])
            for mask in np.unique(usable, axis=0):
                on = np.array(own)[mask]
                at = np.flatnonzero((usable == mask).all(axis=1) & (n > len(on)))
                if not len(at):
                    continue
                b, full = solve(v[np.ix_(at, on, on)], v[at][:, on, -1])
                left = v[at, -1, -1] - 2 * (b * v[at][:, on, -1]).sum(axis=1) + np.einsum("ki,kij,kj->k", b, v[np.ix_(at, on, on)], b)
                # what rounding leaves of an exact fit is none
                left = np.where(left <= 1e-12 * v[at, -1, -1], 0, left)
                with np.errstate(divide="ignore"):
                    aic = n[at] * np.log(left / n[at]) + 2 * len(on)
                better = at[full & (aic < best[at])]
                place = np.searchsorted(at, better)
                best[better], sse[better], terms[better] = aic[place], left[place], len(on)
                damping[better], harmonics[better] = d, h
                beta[better] = 0
                beta[np.ix_(better, on)] = b[place]
        chosen = np.isfinite(best) | (best == -np.inf)
        return batch[list(key)].assign(
            origin=batch["_origin"], last_date=batch["last_date"], n=n, damping=damping, harmonics=harmonics.astype("int32"), n_terms=terms.astype("int32"),
            coefficients=list(beta), sse=sse, aic=np.where(np.isfinite(best), best, np.nan), status=np.where(chosen, "ok", "too_short"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                yield choose(batch)[schema.names]

    ship(moments.sparkSession)
    return moments.mapInPandas(run, schema).withColumn("aic", F.when(~F.isnan("aic"), F.col("aic")))


def predict_selected(
    params: DataFrame, key: Sequence[str], steps: int, candidates: Candidates = Candidates(), confidence: float = 0.95, model: str = "selected",
) -> DataFrame:
    """``steps`` days after each series' last day by its chosen candidate, with normal bounds from its error."""
    ahead = params.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("date", F.date_add("last_date", F.col("step")))
    terms = candidates.design(F.datediff("date", "origin").cast("double"))
    point = ahead.withColumns({
        "forecast": sum((F.get("coefficients", F.lit(i)) * x for i, x in enumerate(terms)), F.lit(0.0)), "sd": F.sqrt(F.col("sse") / F.col("n")),
    })
    return with_interval(point, confidence).select(*key, "step", "date", F.lit(model).alias("model"), "forecast", "lower_bound", "upper_bound")
