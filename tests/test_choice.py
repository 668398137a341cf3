"""Choosing trend and harmonics against numpy, candidate by candidate."""

import numpy as np
import pytest

from tests.helpers import day, series
from tests.test_errors import _many
from tidemark.operators import choice
from tidemark.operators.choice import Candidates

C = Candidates(periods=(7,), harmonics=(1, 2, 3), dampings=(0.0, 0.9, 0.98, 1.0))


def _column(c, k, t):
    trends = c.trends()
    if k == 0:
        return np.ones(len(t))
    if k <= len(trends):
        d = trends[k - 1]
        return t / 1000 if d == 1 else (1 - d ** t) * d / (1 - d)
    wave, cosine = divmod(k - 1 - len(trends), 2)
    p, h = c.waves()[wave]
    return (np.cos if cosine else np.sin)(2 * np.pi * h * t / p)


def _best(c, y):
    t, out = np.arange(len(y), dtype=float), []
    for d, h, own in c.each():
        x = np.stack([_column(c, k, t) for k in own], axis=1)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        sse = ((y - x @ beta) ** 2).sum()
        out.append((len(y) * np.log(sse / len(y)) + 2 * len(own), d, h, len(own), sse))
    return min(out, key=lambda o: o[0])


def _wavy(rng, n, slope, harmonics):
    t = np.arange(n)
    return 20 + slope * t + sum(4 / h * np.sin(2 * np.pi * h * t / 7 + h) for h in range(1, harmonics + 1)) + rng.normal(0, 1, n)


def test_choice_equals_fitting_every_candidate(spark):
    rng = np.random.default_rng(1)
    values = {f"s{i}": _wavy(rng, 60 + i, rng.choice([0, 0, 0.3]), rng.integers(1, 4)) for i in range(40)}
    rows = {r.k: r for r in choice.select_harmonic(_many(spark, values), ["k"], C).collect()}
    for k, y in values.items():
        aic, d, h, n_terms, sse = _best(C, y)
        r = rows[k]
        assert (r.damping, r.harmonics, r.n_terms, r.n, r.status) == (d, h, n_terms, len(y), "ok")
        assert r.aic == pytest.approx(aic, rel=1e-6) and r.sse == pytest.approx(sse, rel=1e-6)
    assert len({(r.damping, r.harmonics) for r in rows.values()}) > 3


def test_planted_shapes_are_found_and_carried_on(spark):
    rng = np.random.default_rng(2)
    t = np.arange(200)
    values = {"flat": _wavy(rng, 200, 0, 1), "rising": _wavy(rng, 200, 0.5, 3), "levelling": 50 + 30 * (1 - 0.9 ** t) + _wavy(rng, 200, 0, 2)}
    params = choice.select_harmonic(_many(spark, values), ["k"], C)
    rows = {r.k: r for r in params.collect()}
    assert rows["flat"].damping in (0.0, 0.9, 0.98) and rows["flat"].harmonics == 1
    assert (rows["rising"].damping, rows["rising"].harmonics) == (1.0, 3) and rows["levelling"].damping == 0.9 and rows["levelling"].harmonics >= 2
    ahead = [r for r in choice.predict_selected(params, ["k"], 7, C).collect() if r.k == "rising"]
    for r in ahead:
        step = 199 + r.step
        true = 20 + 0.5 * step + sum(4 / h * np.sin(2 * np.pi * h * step / 7 + h) for h in (1, 2, 3))
        assert r.date == day(step) and abs(r.forecast - true) < 2 and r.lower_bound < true < r.upper_bound


def test_short_constant_and_null_series(spark):
    df = series(spark, [3.0, None, 5.0], "short").unionByName(series(spark, [4.0] * 30, "flat")).unionByName(series(spark, [1.0], "one")).unionByName(
        series(spark, [float(i % 5) for i in range(12)], "few"))
    rows = {r.k: r for r in choice.select_harmonic(df, ["k"], C).collect()}
    assert rows["one"].status == "too_short" and rows["one"].coefficients[0] == 1.0 and rows["one"].aic is None
    assert rows["flat"].status == "ok" and rows["flat"].n_terms <= 3 and rows["flat"].aic is None and rows["flat"].sse == 0
    assert rows["few"].n_terms <= 2 and rows["few"].status == "ok"  # 12 days are under two weeks
    assert rows["short"].n == 2 and set(rows) == {"short", "flat", "one", "few"}
    assert choice.select_harmonic(df.limit(0), ["k"], C).count() == 0
