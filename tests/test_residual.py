import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tests.helpers import series
from tidemark.operators import features, forecast, residual
from tidemark.plans import forecasting
from tidemark.sources import models

SMALL = residual.ForestSettings(trees=5, depth=4)


@pytest.fixture(scope="module")
def data(spark):
    df = series(spark, [10 + (i % 7) ** 2 + 0.1 * i for i in range(150)])
    fitted = df.select("k", "date", F.col("value").alias("actual"), F.lit(15.0).alias("fitted"),
                       (F.col("value") - 15).alias("residual"))
    return df, fitted


@pytest.fixture(scope="module")
def correction(data):
    return forecasting.correct(*data, ["k"], settings=SMALL)


def test_forest_learns_the_residual(correction):
    rows = {r.part: r for r in correction.metrics.collect()}
    assert rows["train"].r2 > 0.9 and rows["test"].r2 > 0.5
    assert rows["train"].n_rows + rows["test"].n_rows == 150


def test_correction_adds_the_expected_residual(correction):
    row = correction.corrected.first()
    assert row.corrected == pytest.approx(row.fitted + row.predicted_residual)
    assert correction.corrected.count() == 150


def test_importances_fall_and_add_up(correction):
    rows = [r.importance for r in correction.importances.collect()]
    assert rows == sorted(rows, reverse=True) and sum(rows) == pytest.approx(1)


def test_split_does_not_depend_on_partitions(spark, data):
    df, _ = data
    one, two = residual.split(df, ["k"])[1], residual.split(df.repartition(7), ["k"])[1]
    assert sorted(one.collect()) == sorted(two.collect())
    assert 10 < one.count() < 60


def test_a_forest_does_not_depend_on_the_partitions_of_its_rows(spark, data):
    df, fitted = data
    rows = residual.align(features.feature_table(df, ["k"]), fitted, ["k"])
    names = features.feature_names(rows.drop("residual"), ["k"])
    found = set()
    for n in (1, 4, 16):
        model = residual.train(rows.repartition(n), names, residual.ForestSettings(trees=10, depth=4), key=["k"])
        found.add(model.transform(rows).agg(F.sum(F.round("predicted_residual", 9))).first()[0])
    assert len({round(x, 6) for x in found}) == 1


def test_alignment_is_inner_and_without_nulls(spark, data):
    df, fitted = data
    table = features.feature_table(df, ["k"])
    rows = residual.align(table, fitted.filter("date > '2024-02-01'").withColumn("residual", F.lit(None).cast("double")), ["k"])
    assert rows.count() == 150 - 32 and rows.filter("residual <> 0 or residual is null").count() == 0


def test_search(spark, data):
    df, fitted = data
    table = features.feature_table(df, ["k"], lags=False, rolling=False)
    rows = residual.align(table, fitted, ["k"])
    names = features.feature_names(table, ["k"])
    best, scores = residual.search(rows, names, ["k"], {"numTrees": (3,), "maxDepth": (1, 5)}, folds=2)
    assert len(scores) == 2 and scores[1][1] < scores[0][1]
    assert best.stages[-1].getOrDefault("maxDepth") == 5


def test_search_grows_one_forest_for_all_depths_and_scores_each(spark, data, monkeypatch):
    df, fitted = data
    table = features.feature_table(df, ["k"], rolling=False)
    rows = residual.align(table, fitted.withColumn("residual", F.col("residual") + F.dayofmonth("date") % 5), ["k"]).cache()
    names = features.feature_names(table, ["k"])
    grid = {"numTrees": (3,), "maxDepth": (0, 2, 4, residual.MAX_DEPTH), "minInstancesPerNode": (1, 4)}
    settings = residual.ForestSettings(partitions=2)
    grown, made = [], []
    grow, make = RandomForestRegressor._fit_java, RandomForestRegressor._create_model
    with monkeypatch.context() as m:
        m.setattr(RandomForestRegressor, "_fit_java", lambda self, d: grown.append(self.getMaxDepth()) or grow(self, d))
        m.setattr(RandomForestRegressor, "_create_model", lambda self, j: made.append(j) or make(self, j))
        best, scores = residual.search(rows, names, ["k"], grid, folds=2, settings=settings)
    assert len(grown) == 2 * 2 + 1 and len(made) == 1  # folds by settings but for the depth, and the best

    pipeline = residual._pipeline(names, settings, "residual")
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(pipeline.getStages()[-1], name), list(values))
    maps = builder.build()
    folded = rows.withColumn("_fold", F.floor(residual._share_of(["k"], "date", "fold") * 2).cast("int"))
    plain = CrossValidator(
        estimator=pipeline, estimatorParamMaps=maps, numFolds=2, foldCol="_fold",
        evaluator=RegressionEvaluator(labelCol="residual", predictionCol="predicted_residual", metricName="mse"),
    ).fit(residual._laid_out(folded, ["k"], "date", settings))
    assert [s for s, _ in scores] == [{p.name: v for p, v in m.items()} for m in maps]
    np.testing.assert_allclose([s for _, s in scores], plain.avgMetrics, rtol=1e-9)
    chosen = scores[int(np.argmin(plain.avgMetrics))][0]
    assert {name: best.stages[-1].getOrDefault(name) for name in grid} == chosen


def test_search_names_an_empty_fold(spark, data):
    df, fitted = data
    rows = residual.align(features.add_trend(df, ["k"]).select("k", "date", "trend"), fitted, ["k"]).limit(1)
    with pytest.raises(ValueError, match="is empty"):
        residual.search(rows, ["trend"], ["k"], {"numTrees": (2,)}, folds=2)


def test_full_grid_is_the_stated_one():
    sizes = [len(v) for v in residual.GRID.values()]
    assert np.prod(sizes) == 36


def test_forest_is_saved_whole(spark, data, correction, tmp_path):
    df, fitted = data
    models.save_forest(correction.model, str(tmp_path / "m"))
    table = features.feature_table(df, ["k"])
    again = residual.correct(fitted, table, models.load_forest(str(tmp_path / "m")), ["k"], "fitted")
    assert sorted(again.collect()) == sorted(correction.corrected.collect())


def test_forecaster_is_saved_whole(spark, data, tmp_path):
    df, _ = data
    spec = forecast.Harmonic(periods=(7,))
    params = forecast.fit_harmonic(df, ["k"], spec)
    fitted = forecast.fitted_values(df, params, ["k"], spec)
    models.save_forecaster(params, fitted, str(tmp_path / "f"))
    loaded, loaded_fit = models.load_forecaster(spark, str(tmp_path / "f"), ["k"])
    a = forecast.predict_harmonic(loaded, loaded_fit, ["k"], 3, spec).orderBy("step").collect()
    b = forecast.predict_harmonic(params, fitted, ["k"], 3, spec).orderBy("step").collect()
    np.testing.assert_allclose([r.forecast for r in a], [r.forecast for r in b])
    with pytest.raises(ValueError, match="key"):
        models.load_forecaster(spark, str(tmp_path / "f"), ["city"])
