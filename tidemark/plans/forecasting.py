"""Forecasting many series: gate, fill, fit, evaluate, predict, combine, correct."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ..operators import clean, features, fill, forecast, residual
from ..storage import materialise


@dataclass(frozen=True)
class Forecasts:
    """What a forecasting run gives; lazy except for the parameters, which are stored."""

    params: DataFrame
    fitted: DataFrame
    metrics: DataFrame
    predictions: DataFrame
    combined: DataFrame


def run(df: DataFrame, key: Sequence[str], steps: int = 7, spec: forecast.Harmonic = forecast.Harmonic(),
        confidence: float = 0.95, weights: dict[str, float] | None = None, value: str = "value") -> Forecasts:
    """All models on the series that pass the gate.

    The filled series and the parameters (one row per series) feed several results, so they
    are written once to the shared folder and not computed again for each.
    """
    ready = materialise(fill.interpolate_or_mean(clean.modellable(df, key, value), key, value), "series")
    params = materialise(forecast.fit_harmonic(ready, key, spec, value), "params")
    fitted = forecast.fitted_values(ready, params, key, spec, value)
    simple = forecast.predict_simple(forecast.fit_simple(ready, key, value), key, steps, confidence)
    harmonic = forecast.predict_harmonic(params, fitted, key, steps, spec, confidence)
    predictions = simple.unionByName(harmonic)
    return Forecasts(params, fitted, forecast.fit_metrics(fitted, key), predictions,
                     forecast.ensemble(predictions, key, weights))


@dataclass(frozen=True)
class Correction:
    """A trained residual model with its evaluation and the corrected fitted values."""

    model: PipelineModel
    metrics: DataFrame
    importances: DataFrame
    corrected: DataFrame


def correct(df: DataFrame, fitted: DataFrame, key: Sequence[str], climate: DataFrame | None = None,
            settings: residual.ForestSettings = residual.ForestSettings(), value: str = "value") -> Correction:
    """Learn the residuals of ``fitted`` from features of the series and add them back.

    Tree building reads its rows many times, so the aligned table is written once.
    """
    table = features.feature_table(df, key, value, climate)
    names = features.feature_names(table, key, value)
    rows = materialise(residual.align(table, fitted, key), "features")
    training, test = residual.split(rows, key, settings.test_share)
    model = residual.train(training, names, settings, key=key)
    return Correction(
        model=model,
        metrics=residual.train_and_test_metrics(model, training, test),
        importances=residual.importances(model, training),
        corrected=residual.correct(fitted, table, model, key, "fitted"),
    )
