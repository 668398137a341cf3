"""Forests by series against means, a greedy search in numpy, and planted effects."""

import numpy as np
from pyspark.sql import functions as F

from tests.helpers import day
from tidemark.operators import series_forest
from tidemark.operators.series_forest import SeriesForest

ONE = SeriesForest(trees=1, depth=3, bins=128, bootstrap=False)


def _table(spark, rows):
    return spark.createDataFrame(rows, "k string, date date, a double, b double, y double")


def _tree(x, y, depth, least=2):
    """Predictions of a tree grown by trying every split."""
    out = np.full(len(y), y.mean())
    if not depth:
        return out
    best = (1e-12, None)
    for f in range(x.shape[1]):
        for e in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= e
            if least <= left.sum() <= len(y) - least:
                gain = left.sum() * (~left).sum() / len(y) * (y[left].mean() - y[~left].mean()) ** 2
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, left)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = _tree(x[side], y[side], depth - 1, least)
    return out


def test_one_tree_equals_trying_every_split(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in ("p", "q", "r"):
        x = np.stack([rng.integers(0, 7, 60), rng.integers(0, 4, 60)], axis=1).astype(float)
        y = rng.normal(0, 1, 60) + 3 * (x[:, 0] > 4) * (1 if k == "p" else -1) + 2 * (x[:, 1] == 2) * (k == "q")
        rows += [(k, day(i), *map(float, x[i]), float(y[i])) for i in range(60)]
        want.update({(k, day(i)): v for i, v in enumerate(_tree(x, y, 3))})
    df = _table(spark, rows)
    model = series_forest.fit(df, ["k"], ["a", "b"], "y", ONE)
    got = {(r.k, r.date): r.predicted for r in series_forest.predict(df, model, ["k"], ["a", "b"], ONE).collect()}
    assert set(got) == set(want)
    np.testing.assert_allclose([got[p] for p in sorted(got)], [want[p] for p in sorted(got)], rtol=1e-9)
    roots = {r.k: (r.feature, r.threshold) for r in model.filter("node = 1").collect()}
    assert set(roots.values()) == {(0, 4.0)} and model.filter("value is not null").select("k", "node", "value").distinct().count() > 15


def test_forest_learns_what_differs_between_series(spark):
    rng = np.random.default_rng(2)
    effect = {"a": lambda x: 4 * (x[0] >= 3), "b": lambda x: -4 * (x[0] >= 3), "c": lambda x: 5 * (x[1] == 1), "d": lambda x: 0 * x[0], "e": lambda x: 2 * x[0]}
    rows = []
    for k, f in effect.items():
        for i in range(300):
            x = (float(rng.integers(0, 7)), float(rng.integers(0, 3)))
            rows.append((k, day(i), *x, float(f(x) + rng.normal(0, 0.5))))
    df, settings = _table(spark, rows), SeriesForest(trees=8, depth=4)
    model = series_forest.fit(df.filter(F.datediff("date", F.lit(day(0))) < 250), ["k"], ["a", "b"], "y", settings)
    tested = series_forest.predict(df.filter(F.datediff("date", F.lit(day(0))) >= 250), model, ["k"], ["a", "b"], settings).collect()
    for k, f in effect.items():
        error = np.mean([(r.predicted - f((r.a, r.b))) ** 2 for r in tested if r.k == k])
        assert error < 0.2, (k, error)
    assert model.select("tree").distinct().count() == 8
    again = series_forest.fit(df.filter(F.datediff("date", F.lit(day(0))) < 250).repartition(3), ["k"], ["a", "b"], "y", settings)
    key = lambda m: sorted((r.k, r.tree, r.node, r.feature, r.threshold, round(r.n or 0, 6)) for r in m.fillna(-1, ["feature"]).fillna(-1.0, ["threshold"]).collect())
    assert key(model) == key(again)


def test_nulls_constants_and_series_without_rows(spark):
    df = _table(spark, [("a", day(i), None if i % 2 else 1.0, 5.0, 3.0 if i % 2 else 7.0) for i in range(20)] + [("b", day(0), 1.0, 1.0, 2.0), ("c", day(0), 1.0, 1.0, None)])
    model = series_forest.fit(df, ["k"], ["a", "b"], "y", ONE)
    got = {r.k: r.predicted for r in series_forest.predict(df, model, ["k"], ["a", "b"], ONE).filter("date = '2024-01-01'").collect()}
    assert got["b"] == 2.0 and got["c"] is None
    empty = series_forest.fit(df.limit(0), ["k"], ["a", "b"], "y", ONE)
    assert empty.count() == 0 and series_forest.predict(df, empty, ["k"], ["a", "b"], ONE).filter("predicted is not null").count() == 0
