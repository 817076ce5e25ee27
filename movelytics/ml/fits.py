"""Pipelines and hold-out fits: regressors on the target or on the residual to a proxy, classifiers, mixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prepared(numeric: list[str], categorical: list[str]) -> list:
    """Index categories (unseen ones kept apart), fill numbers by their medians, assemble."""
    stages = [StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep")] if categorical else []
    stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_f" for c in numeric]))
    stages.append(VectorAssembler(inputCols=[f"{c}_f" for c in numeric] + [f"{c}_i" for c in categorical], outputCol="features", handleInvalid="keep"))
    return stages


def regressor(train: DataFrame, label: str, numeric: list[str], categorical: list[str], rounds: int = 10, early: str | None = None, weight: str | None = None, robust: bool = False, out: str = "fitted", seed: int = 7) -> PipelineModel:
    """Boosted trees (stopped early on the rows flagged by `early`), or a Huber regression with robust=True."""
    if robust:
        last = LinearRegression(labelCol=label, loss="huber", solver="l-bfgs", regParam=0.01, maxIter=30, predictionCol=out)
    else:
        last = GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=4, seed=seed, predictionCol=out, maxBins=64)
        if early:
            last = last.setValidationIndicatorCol(early)
    if weight:
        last = last.setWeightCol(weight)
    return Pipeline(stages=[*prepared(numeric, categorical), last]).fit(train)


def classifier(train: DataFrame, label: str, numeric: list[str], categorical: list[str], rounds: int = 10, classes: int = 2, weight: str | None = None, out: str = "chance", seed: int = 7) -> PipelineModel:
    if classes == 2:
        last = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=4, seed=seed, maxBins=64)
    else:
        last = RandomForestClassifier(labelCol=label, numTrees=rounds, maxDepth=5, seed=seed, maxBins=64)
    last = last.setProbabilityCol(out).setPredictionCol(f"{out}_label").setRawPredictionCol(f"{out}_raw")
    if weight:
        last = last.setWeightCol(weight)
    return Pipeline(stages=[*prepared(numeric, categorical), last]).fit(train)


def chance(c: str, k: int = 1) -> Column:
    """Probability of class k from a probability vector."""
    return vector_to_array(c)[k]


def out_of_fold(df: DataFrame, folds: list[tuple[str, Column]], fit, keep: list[str]) -> DataFrame:
    """Union over hold-outs: fit on the rows outside of each and score those in it."""
    parts = [fit(df.where(~held)).transform(df.where(held)).select(*keep, "fitted", F.lit(name).alias("holdout")) for name, held in folds]
    return reduce(DataFrame.unionByName, parts)
