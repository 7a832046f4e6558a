"""Learners, routed and specialist models, baselines, calibration."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymosaic.functions.numeric import logit
from daymosaic.modelling.prepare import WIDE, Imputer, encoder, fit_imputer, split_by_width
from daymosaic.operators.joins import value_map

# The published learner settings. Published trees have no depth
# bound; 30 is the deepest that MLlib allows.
TREES, MIN_LEAF, SEED = 400, 2, 42
ROUNDS, STEP = 400, 0.05
#: Megabytes of histograms that one pass over the rows may fill: more nodes are split in a pass.
NODE_MB = 1024
#: Training rows that a task reads at least.
TASK_ROWS = 10_000
HELPER_COLUMNS = ("rawPrediction", "probability", "prediction", "numeric__raw", "numeric__scaled", "numeric__scaled__population", "features")


def forest(y: str, trees: int = TREES, depth: int = 30, weight: str | None = None) -> RandomForestClassifier:
    m = RandomForestClassifier(labelCol=y, featuresCol="features", numTrees=trees, maxDepth=depth,
                               minInstancesPerNode=MIN_LEAF, featureSubsetStrategy="sqrt", seed=SEED,
                               maxMemoryInMB=NODE_MB, cacheNodeIds=True)
    return m.setWeightCol(weight) if weight else m


def boosted(y: str, rounds: int = ROUNDS, depth: int = 6, weight: str | None = None) -> GBTClassifier:
    m = GBTClassifier(labelCol=y, featuresCol="features", maxIter=rounds, stepSize=STEP, maxDepth=depth,
                      subsamplingRate=1.0, seed=SEED, maxMemoryInMB=NODE_MB)
    return m.setWeightCol(weight) if weight else m


def logistic(y: str, train_rows: int, weight: str | None = None) -> LogisticRegression:
    """L2 logistic regression with unit penalty strength on pre-scaled features."""
    m = LogisticRegression(labelCol=y, featuresCol="features", regParam=1.0 / train_rows,
                           standardization=False, maxIter=1000)
    return m.setWeightCol(weight) if weight else m


@dataclass(frozen=True)
class Fitted:
    """Imputer and pipeline fitted on the training rows only."""

    imputer: Imputer
    model: PipelineModel

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Add the probability of the positive class; helper vectors are dropped."""
        s = self.model.transform(self.imputer.transform(df))
        s = s.withColumn(out, vector_to_array("probability")[1])
        return drop_helpers(s)


def drop_helpers(scored: DataFrame) -> DataFrame:
    return scored.drop(*[c for c in scored.columns if c in HELPER_COLUMNS or c.endswith(("__index", "__hot", "__terms"))])


def fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], learner,
        scale: bool = False, wide: int = WIDE) -> Fitted:
    """Impute, encode, learn. The training rows are read many times, so they are
    cached (spilling to disk) for the length of the fit. Categories of over ``wide`` values are hashed."""
    imputer = fit_imputer(train, numeric, categorical)
    prepared = imputer.transform(train)
    # a learner runs hundreds of short passes: a task too small costs more to start than to run
    tasks = max(1, math.ceil(prepared.count() / TASK_ROWS))
    prepared = (prepared.coalesce(tasks) if tasks < prepared.rdd.getNumPartitions() else prepared).persist()
    try:
        narrow, hashed = split_by_width(prepared, categorical, wide)
        steps = encoder(numeric, narrow, scale, hashed=hashed).getStages()
        return Fitted(imputer, Pipeline(stages=[*steps, learner]).fit(prepared))
    finally:
        prepared.unpersist()


def gradient(fitted: Fitted, train: DataFrame, y: str) -> float:
    """The largest component of the gradient of a logistic model's penalised mean log loss over its training rows."""
    m = fitted.model.stages[-1]
    scored = fitted.model.transform(fitted.imputer.transform(train))
    error = vector_to_array("probability")[1] - F.col(y)
    parts = scored.select(vector_to_array("features").alias("x"), error.alias("e")).select(F.posexplode("x").alias("i", "x"), "e").filter(
        "x <> 0").groupBy("i").agg(F.sum(F.col("x") * F.col("e")).alias("g")).collect()
    n, bias = train.count(), scored.agg(F.avg(error)).first()[0]
    by = {r["i"]: r["g"] / n for r in parts}
    steps = [by.get(i, 0.0) + m.getRegParam() * w for i, w in enumerate(m.coefficients.toArray())]
    return float(max(abs(bias), *map(abs, steps)))


@dataclass(frozen=True)
class Routed:
    """Two models, chosen per row by the current regime."""

    onset: Fitted
    continuation: Fitted
    is_elevated: Column

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        calm = self.onset.score(df.filter(~self.is_elevated), out)
        busy = self.continuation.score(df.filter(self.is_elevated), out)
        return calm.unionByName(busy)


def fit_routed(train: DataFrame, is_elevated: Column, fit_one: Callable[[DataFrame], Fitted]) -> Routed:
    return Routed(fit_one(train.filter(~is_elevated)), fit_one(train.filter(is_elevated)), is_elevated)


def persistence(df: DataFrame, count: str, out: str = "y_pred", threshold: float = 2.0) -> DataFrame:
    """Tomorrow is like today."""
    return df.withColumn(out, (F.col(count) > threshold).cast("int"))


def climatology(train: DataFrame, df: DataFrame, y: str, keys: Sequence[str] = (),
                out: str = "score") -> DataFrame:
    """Training rate, per key when keys are given; unknown keys get the overall rate."""
    overall = train.agg(F.avg(y)).scalar()
    if not keys:
        return df.withColumn(out, overall)
    return value_map(df, train.groupBy(*keys).agg(F.avg(y).alias("_rate")), keys, "_rate", overall, out)


@dataclass(frozen=True)
class Platt:
    """Logistic map on the log-odds of a score."""

    model: PipelineModel

    def transform(self, df: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
        s = self.model.transform(df.withColumn("__logit", logit(score)))
        return s.withColumn(out, vector_to_array("probability")[1]).drop(
            "__logit", "__v", "rawPrediction", "probability", "prediction")


def fit_platt(scored: DataFrame, score: str, y: str) -> Platt:
    """Fitted on one period; check it on a second before it is applied to the test."""
    rows = scored.select(logit(score).alias("__logit"), F.col(y).cast("double").alias(y)).persist()
    try:
        m = LogisticRegression(labelCol=y, featuresCol="__v", regParam=1.0 / rows.count(),
                               standardization=False, maxIter=1000)
        return Platt(Pipeline(stages=[VectorAssembler(inputCols=["__logit"], outputCol="__v"), m]).fit(rows))
    finally:
        rows.unpersist()


def feature_importance(fitted: Fitted, scored_schema_from: DataFrame) -> DataFrame:
    """(feature, importance), largest first. Names come from the vector's metadata."""
    spark = scored_schema_from.sparkSession
    steps = PipelineModel(fitted.model.stages[:-1])
    attrs = steps.transform(fitted.imputer.transform(scored_schema_from)).schema["features"].metadata["ml_attr"]["attrs"]
    names: Mapping[int, str] = {a["idx"]: a.get("name", f"hashed_{a['idx']}") for group in attrs.values() for a in group}
    values = fitted.model.stages[-1].featureImportances.toArray()
    rows = [(names[i].replace("__hot_", "="), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature")
