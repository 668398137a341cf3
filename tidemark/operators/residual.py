"""Learning what a forecast leaves over: training, search, evaluation and correction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..storage import fresh_path, remove, ship

MAX_DEPTH = 30  # the deepest tree MLlib grows; stands for "no limit"
SLICE = 1000  # rows that walk down all trees at a time

# The nodes of a stored forest, as MLlib writes them.
NODES = """treeID int, nodeData struct<id: int, prediction: double, leftChild: int, rightChild: int,
    split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>>>"""

# The search grid.
GRID = {"numTrees": (50, 100, 200), "maxDepth": (5, 10, 15, MAX_DEPTH), "minInstancesPerNode": (1, 2, 4)}


@dataclass(frozen=True)
class ForestSettings:
    """Settings of the residual forest. Without ``bootstrap`` every tree sees every row."""

    trees: int = 100
    depth: int = 10
    min_leaf: int = 1
    seed: int = 42
    bootstrap: bool = True
    partitions: int = 8
    test_share: float = 0.2


def align(features: DataFrame, targets: DataFrame, key: Sequence[str], target: str = "residual",
          date: str = "date") -> DataFrame:
    """Feature rows that have a target, nulls as 0."""
    joined = features.join(targets.select(*key, date, target), [*key, date])
    return joined.fillna(0)


def _share_of(df_key: Sequence[str], date: str, salt: str):
    """A number in [0, 1) that depends on the row's key and date only, not on its partition: 32 bits of their MD5."""
    name = F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in df_key], F.col(date).cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") / 4294967296.0


def split(df: DataFrame, key: Sequence[str], test_share: float = 0.2, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Training and test rows; the same rows on every run and under any partitioning."""
    share = _share_of(key, date, "split")
    return df.filter(share >= test_share), df.filter(share < test_share)


def _pipeline(features: Sequence[str], settings: ForestSettings, target: str) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        RandomForestRegressor(
            featuresCol="_scaled", labelCol=target, predictionCol="predicted_residual",
            numTrees=settings.trees, maxDepth=settings.depth, minInstancesPerNode=settings.min_leaf,
            featureSubsetStrategy="all", seed=settings.seed, bootstrap=settings.bootstrap,
        ),
    ])


def _laid_out(rows: DataFrame, key: Sequence[str], date: str, settings: ForestSettings) -> DataFrame:
    """Rows in the stated number of partitions, by hash of key and date and in their order.

    The forest draws its bootstrap rows for each partition, so equal rows give equal trees only in an equal layout.
    The number is a setting of the model, to be raised with the data, and not taken from the cluster.
    """
    return rows.repartition(settings.partitions, *key, date).sortWithinPartitions(*key, date)


def train(rows: DataFrame, features: Sequence[str], settings: ForestSettings = ForestSettings(),
          target: str = "residual", key: Sequence[str] = (), date: str = "date") -> PipelineModel:
    """Assemble, standardise and grow the forest on training rows."""
    return _pipeline(features, settings, target).fit(_laid_out(rows, key, date, settings))


def search(rows: DataFrame, features: Sequence[str], key: Sequence[str], grid: dict[str, Sequence[int]] | None = None,
           folds: int = 5, settings: ForestSettings = ForestSettings(), parallelism: int = 4,
           target: str = "residual", date: str = "date"):
    """Grid search by cross-validated squared error; folds by a hash of key and date.

    Settings that differ in their depth alone share one forest, grown to the largest depth: every feature is tried at
    each node, so the forest of a smaller depth is the same one cut there. A fold is scaled once for all settings.
    Returns the best model and a list of (setting, mean mse).
    """
    pipeline = _pipeline(features, settings, target)
    *scaling, forest = pipeline.getStages()
    builder = ParamGridBuilder()
    for name, values in (grid or GRID).items():
        builder = builder.addGrid(getattr(forest, name), list(values))
    maps = builder.build()
    alike: dict[tuple, list[int]] = {}
    for i, m in enumerate(maps):
        # features drawn at random for a node depend on the nodes before it, and so on the depth
        drawn = forest.featureSubsetStrategy in m
        alike.setdefault(tuple((p.name, v) for p, v in m.items() if drawn or p != forest.maxDepth), []).append(i)
    # the largest forests first, so that none is begun last
    shared = sorted(alike.values(), key=lambda g: -maps[g[0]].get(forest.numTrees, settings.trees))
    depths = [m.get(forest.maxDepth, settings.depth) for m in maps]

    folded = rows.withColumn("_fold", F.floor(_share_of(key, date, "fold") * folds).cast("int"))
    laid = _laid_out(folded, key, date, settings).cache()
    errors = np.zeros((folds, len(maps)))
    ship(rows.sparkSession)
    try:
        with ThreadPool(min(parallelism, len(shared))) as pool:
            for fold in range(folds):
                training, validation = laid.filter(F.col("_fold") != fold), laid.filter(F.col("_fold") == fold)
                for part, name in ((training, "training"), (validation, "validation")):
                    if part.isEmpty():
                        raise ValueError(f"The {name} data at fold {fold} is empty.")
                scaler = Pipeline(stages=scaling).fit(training)
                training, validation = (scaler.transform(part).select("_scaled", target).cache() for part in (training, validation))

                def score(group: list[int]) -> None:
                    deepest = max(depths[i] for i in group)
                    grown = forest.copy({**maps[group[0]], forest.maxDepth: deepest})
                    errors[fold, group] = _cut_errors(grown, training, validation, [depths[i] for i in group], target)

                pool.map(inheritable_thread_target(rows.sparkSession)(score), shared, chunksize=1)
                training.unpersist()
                validation.unpersist()
        means = errors.mean(axis=0)
        scores = [({p.name: v for p, v in m.items()}, float(s)) for m, s in zip(maps, means)]
        return pipeline.fit(laid, maps[int(np.argmin(means))]), scores
    finally:
        laid.unpersist()


def _cut_errors(forest: RandomForestRegressor, training: DataFrame, validation: DataFrame, depths: Sequence[int],
                target: str) -> list[float]:
    """Grow the forest on the training rows; the mean squared errors on the others when it is cut at each of the depths.

    Like a model of MLlib the forest goes along to each task. It is not made a model in Python, which would wrap every
    tree and take longer than growing them.
    """
    spark = training.sparkSession
    nodes = spark.sparkContext.broadcast(_nodes(spark, forest._fit_java(training)))

    def walk(batches):
        for batch in batches:
            for begin in range(0, len(batch), SLICE):
                part = batch.iloc[begin:begin + SLICE]
                found = cut_predictions(nodes.value, np.stack(part["x"].to_numpy()), depths)
                yield pd.DataFrame({"y": part["y"].to_numpy(), "predicted": list(found)})

    predicted = validation.select(vector_to_array("_scaled").alias("x"), F.col(target).cast("double").alias("y")).mapInPandas(
        walk, "y double, predicted array<double>"
    )
    errors = [F.col("y") - F.col("predicted")[i] for i in range(len(depths))]
    try:
        return list(predicted.agg(*[F.avg(e * e) for e in errors]).first())
    finally:
        nodes.destroy()


def _nodes(spark: SparkSession, model) -> dict[str, np.ndarray]:
    """All trees of a grown forest as arrays with an entry for each node; a leaf is its own child."""
    path = fresh_path(spark, "forest")
    model.write().save(path)
    node, split = F.col("nodeData"), F.col("nodeData.split")
    stored = spark.read.schema(NODES).parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["prediction"].alias("prediction"), node["leftChild"].alias("left"),
        node["rightChild"].alias("right"), split["featureIndex"].alias("feature"),
        F.coalesce(F.get(split["leftCategoriesOrThreshold"], 0), F.lit(0.0)).alias("threshold"),
    ).toArrow()
    remove(spark, path)
    out = {name: stored[name].to_numpy() for name in stored.column_names}
    order = np.lexsort((out["id"], out["treeID"]))
    out = {name: values[order] for name, values in out.items()}
    roots = np.flatnonzero(out["id"] == 0)
    first = np.repeat(roots, np.diff(np.append(roots, len(order))))
    leaf = out["left"] < 0
    for side in ("left", "right"):
        out[side] = np.where(leaf, np.arange(len(order)), first + out[side])
    out["feature"] = np.where(leaf, 0, out["feature"])
    return {"roots": roots} | {name: out[name] for name in ("prediction", "left", "right", "feature", "threshold")}


def cut_predictions(nodes: dict[str, np.ndarray], x: np.ndarray, depths: Sequence[int]) -> np.ndarray:
    """What the forest says of each row when its trees end at each of the depths: rows by depths."""
    at = np.tile(nodes["roots"], (len(x), 1))
    row = np.arange(len(x))[:, None]
    out = np.empty((len(x), len(depths)))
    for level in range(max(depths) + 1):
        for i, depth in enumerate(depths):
            if depth == level:
                # tree after tree, as MLlib adds them up
                out[:, i] = np.cumsum(nodes["prediction"][at], axis=1)[:, -1] / at.shape[1]
        left = x[row, nodes["feature"][at]] <= nodes["threshold"][at]
        at = np.where(left, nodes["left"][at], nodes["right"][at])
    return out


def regression_metrics(rows: DataFrame, actual: str, predicted: str, key: Sequence[str] = ()) -> DataFrame:
    """mse, mae, r2 and rmse of predictions."""
    error = F.col(actual) - F.col(predicted)
    sse = F.sum(error * error)
    # Total squares by the central moment: subtracting squared means would cancel.
    total = F.var_pop(actual) * F.count(actual)
    return rows.groupBy(*key).agg(
        F.count("*").alias("n_rows"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"),
        (1 - ratio(sse, total)).alias("r2"), F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def train_and_test_metrics(model: PipelineModel, training: DataFrame, test: DataFrame,
                           target: str = "residual") -> DataFrame:
    """The metrics on both parts, one row each."""
    both = training.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return regression_metrics(model.transform(both), target, "predicted_residual", ["part"])


def importances(model: PipelineModel, training: DataFrame) -> DataFrame:
    """Features by falling importance."""
    names = model.stages[0].getInputCols()
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(names, weights)]  # one per feature
    return training.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def correct(predictions: DataFrame, features: DataFrame, model: PipelineModel, key: Sequence[str],
            prediction: str = "forecast", date: str = "date") -> DataFrame:
    """Each prediction plus the residual the forest expects, where there are features."""
    joined = predictions.select(*key, date, prediction).join(features, [*key, date]).fillna(0)
    return model.transform(joined).select(
        *key, date, prediction, "predicted_residual",
        (F.col(prediction) + F.col("predicted_residual")).alias("corrected"),
    )
