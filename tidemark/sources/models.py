"""Model persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_forest(model: PipelineModel, path: str) -> None:
    """Scaler, forest and the names of its features in one pipeline."""
    model.write().overwrite().save(path)


def load_forest(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_forecaster(params: DataFrame, fitted: DataFrame, path: str) -> None:
    """Parameters and the fitted and residual values of a forecast model, as two tables."""
    params.write.mode("overwrite").parquet(f"{path}/params")
    fitted.write.mode("overwrite").parquet(f"{path}/fitted")


def load_forecaster(spark: SparkSession, path: str, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    params = spark.read.parquet(f"{path}/params")
    fitted = spark.read.parquet(f"{path}/fitted")
    missing = [k for k in key if k not in params.columns]
    if missing:
        raise ValueError(f"the saved model has no series key {missing}")
    return params, fitted
