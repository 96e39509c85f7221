"""Baseline scorers on flattened windows by Spark ML: weighted logistic regression, random forest, boosted trees."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .flatten import median_impute
from .metrics import average_precision, class_weights


def weighted(df: DataFrame, label: str) -> DataFrame:
    """df with balanced class weights; the weights are one row per class."""
    w = class_weights(df, label).select(F.col(label), F.col("weight").alias("_weight"))
    return df.join(F.broadcast(w), label)


def estimator(kind: str, label: str, seed: int = 42, **options):
    """'logistic', 'elastic_net' (a quarter lasso), 'forest' or 'boosted'."""
    base = {"featuresCol": "_x", "labelCol": label, "weightCol": "_weight"}
    if kind == "logistic":
        return LogisticRegression(**base, **{"regParam": 0.01, **options})
    if kind == "elastic_net":
        return LogisticRegression(**base, **{"regParam": 0.01, "elasticNetParam": 0.25, **options})
    if kind == "forest":
        return RandomForestClassifier(**base, seed=seed, **{"numTrees": 100, "minInstancesPerNode": 5, **options})
    if kind == "boosted":
        return GBTClassifier(**base, seed=seed, **{"maxDepth": 4, "maxIter": 50, "stepSize": 0.1, "subsamplingRate": 0.7, **options})
    raise ValueError(f"unknown kind of model: {kind}")


def fit(train: DataFrame, features: list[str], label: str, kind: str, **options) -> PipelineModel:
    """Median imputation and scaling by the training rows, then the estimator."""
    ready = weighted(median_impute(train, train, features), label)
    steps = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), estimator(kind, label, **options)]
    return Pipeline(stages=steps).fit(ready)


def score(model: PipelineModel, df: DataFrame, train: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    """df with the probability of class 1; missing features take the training rows' medians."""
    out = model.transform(median_impute(df, train, features))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("_raw", "_x", "rawPrediction", "probability", "prediction", "_weight")


def best_boosted(train: DataFrame, val: DataFrame, features: list[str], label: str, grid: dict[str, list]) -> tuple[PipelineModel, dict, float]:
    """The boosted trees of the grid with the highest average precision on val."""
    best = None
    for values in product(*grid.values()):
        options = dict(zip(grid, values, strict=True))
        model = fit(train, features, label, "boosted", **options)
        ap = average_precision(score(model, val, train, features), "score", label).first()[0]
        if best is None or ap > best[2]:
            best = (model, options, ap)
    return best


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features with their importance in a tree model, or size of coefficient, from high to low."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))
