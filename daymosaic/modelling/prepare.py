"""Splits, imputation, encoding, weights."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (ElementwiseProduct, HashingTF, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.operators.joins import join_small
from daymosaic.operators.running import percentiles


def temporal_split(df: DataFrame, years: Mapping[str, int | Sequence[int]],
                   date_col: str = "date") -> dict[str, DataFrame]:
    """One frame per split name by calendar year."""
    y = F.year(date_col)
    return {name: df.filter(y.isin(*([v] if isinstance(v, int) else v))) for name, v in years.items()}


def split_counts(splits: Mapping[str, DataFrame], y: str) -> DataFrame:
    """Rows and positives per split, for row-count gates."""
    out = None
    for name, df in splits.items():
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(y).alias("positives")).select(
            F.lit(name).alias("split"), "rows", "positives")
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Imputer:
    """Train-only fill values: exact medians and modes. An all-NULL column gets 0."""

    values: Mapping[str, object]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})


def fill_values(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """(column, median, mode): the statistics an Imputer is made of.

    All numeric columns are unpivoted and ranked in one distributed pass; a mode
    is the most frequent value, the first by name on ties. A column without
    values keeps its row, with NULLs.
    """
    parts = []
    if numeric:
        long = train.select(F.explode(F.array(*[F.struct(
            F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in numeric])).alias("r"))
        parts.append(percentiles(long.select("r.*"), ["column"], "value", [0.5]).select(
            "column", F.col("p50").alias("median"), F.lit(None).cast("string").alias("mode")))
    if categorical:
        long = train.select(F.explode(F.array(*[F.struct(
            F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categorical])).alias("r"))
        n = long.select("r.*").filter("value is not null").groupBy("column", "value").agg(
            F.count(F.lit(1)).alias("n"))
        top = n.groupBy("column").agg(F.max("n").alias("n"))
        parts.append(n.join(top, ["column", "n"]).groupBy("column").agg(F.min("value").alias("mode")).select(
            "column", F.lit(None).cast("double").alias("median"), "mode"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wanted = train.sparkSession.createDataFrame([(c,) for c in (*numeric, *categorical)], "column string")
    return wanted.join(found, "column", "left")


def fit_imputer(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> Imputer:
    """One row per column comes to the driver: a list the size of the schema."""
    rows = {r["column"]: r for r in fill_values(train, numeric, categorical).collect()}
    return Imputer({c: 0.0 if rows[c]["median"] is None else rows[c]["median"] for c in numeric}
                   | {c: "" if rows[c]["mode"] is None else rows[c]["mode"] for c in categorical})


class PopulationScaler(StandardScaler):
    """Centres and divides by the population deviation. The library divides by the
    sample deviation, so the fitted deviations are corrected by the row count."""

    def __init__(self, inputCol: str, outputCol: str):
        super().__init__(inputCol=inputCol, outputCol=outputCol, withMean=True, withStd=True)

    def _fit(self, dataset: DataFrame):
        n = dataset.count()
        model = super()._fit(dataset)
        if n < 2:
            return model
        factor = math.sqrt((n - 1) / n)
        stretch = ElementwiseProduct(inputCol=self.getOutputCol(), outputCol=self.getOutputCol() + "__population",
                                     scalingVec=Vectors.dense([1 / factor] * len(model.mean)))
        return PipelineModel(stages=[model, stretch])


#: Distinct values up to which a category has a column for each, and the columns that a wider one's values are hashed to.
WIDE, HASHED = 10_000, 4_096


def split_by_width(train: DataFrame, categorical: Sequence[str], wide: int = WIDE) -> tuple[list[str], list[str]]:
    """(narrow, wide) categories by their distinct values, counted without bringing them to the driver."""
    if not categorical:
        return [], []
    n = train.agg(*[F.count_distinct(F.col(c)).alias(c) for c in categorical]).first()
    return [c for c in categorical if n[c] <= wide], [c for c in categorical if n[c] > wide]


def encoder(numeric: Sequence[str], categorical: Sequence[str], scale: bool = False,
            out: str = "features", hashed: Sequence[str] = (), width: int = HASHED) -> Pipeline:
    """One-hot with a train-only vocabulary (unseen values give all zeros) and assembly.

    ``hashed`` categories have no vocabulary: each value, seen or not, counts in one of ``width`` columns that its hash names, and a
    NULL in none. Nothing about them is kept on the driver, however many values there are.
    """
    index = [f"{c}__index" for c in categorical]
    hot = [f"{c}__hot" for c in categorical]
    stages = []
    if categorical:
        # the kept "unseen" slot is the last one, and dropLast turns it into zeros
        stages = [StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep",
                                stringOrderType="alphabetAsc"),
                  OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)]
    if hashed:
        terms = ", ".join(f"concat('{c}=', `{c}`)" for c in hashed)
        stages += [SQLTransformer(statement=f"SELECT *, array_compact(array({terms})) AS hashed__terms FROM __THIS__"),
                   HashingTF(inputCol="hashed__terms", outputCol="hashed__hot", numFeatures=width)]
        hot = [*hot, "hashed__hot"]
    if scale:
        stages += [VectorAssembler(inputCols=list(numeric), outputCol="numeric__raw"),
                   PopulationScaler(inputCol="numeric__raw", outputCol="numeric__scaled"),
                   VectorAssembler(inputCols=["numeric__scaled__population", *hot], outputCol=out)]
    else:
        stages.append(VectorAssembler(inputCols=[*numeric, *hot], outputCol=out))
    return Pipeline(stages=stages)


# The class-weight arms.
CLASS_WEIGHTS: dict[str, object] = {"none": None, "balanced": "balanced", "weight_1_5": 1.5,
                                    "weight_2": 2.0, "weight_3": 3.0}


def class_weight(train: DataFrame, y: str, spec: object, out: str = "class_weight") -> DataFrame:
    """Row weights: none, balanced (n / (2 n_class)) or a factor for positives."""
    if spec is None:
        return train.withColumn(out, F.lit(1.0))
    if spec == "balanced":
        n = train.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
        total = n.agg(F.sum("_n") / F.count(F.lit(1))).scalar()
        return join_small(train, n.select(y, (total / F.col("_n")).alias(out)), [y], "inner")
    return train.withColumn(out, F.when(F.col(y) == 1, float(spec)).otherwise(1.0))
