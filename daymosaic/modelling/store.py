"""Fitted models in a shared folder: the pipeline with its fill values, and a record of how to use it.

A model is a folder ``name/version`` that MLlib writes; the record is a row of a table beside it and is written last, so a model
without a record does not exist yet. The record holds the columns with their types, the target, the frozen threshold and what the
model was trained on. Loading checks it, and a table that lacks a column or holds it in another type is refused before scoring.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from daymosaic.modelling.learners import Fitted, drop_helpers
from daymosaic.modelling.prepare import Imputer
from daymosaic.sources.sinks import replace_partitions

RECORD = ("columns array<struct<name: string, type: string>>, target string, threshold double, train_rows bigint, "
          "train_positives bigint, first_date date, last_date date, name string, version int")


class ModelMismatch(ValueError):
    """The rows, the columns asked for or the record do not fit the stored model."""


class FillValues(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The imputer's fill values as a stage that is stored with the pipeline."""

    values = Param(Params._dummy(), "values", "fill value by column")

    @keyword_only
    def __init__(self, *, values: Mapping[str, object] | None = None):
        super().__init__()
        if values is not None:
            self._set(values=dict(values))

    def _transform(self, df: DataFrame) -> DataFrame:
        return Imputer(self.getOrDefault(self.values)).transform(df)


def save_model(fitted: Fitted, train: DataFrame, folder: str, name: str, version: int, columns: Sequence[str], target: str,
               threshold: float, date_col: str = "date") -> Row:
    """Store a fitted model and its record; returns the record. A version is written once."""
    if not 0 < threshold < 1:
        raise ModelMismatch(f"{name}: threshold {threshold} is outside (0, 1)")
    types = dict(train.dtypes)
    spark = train.sparkSession
    known = records(spark, folder)
    if known is not None and known.filter((F.col("name") == name) & (F.col("version") == version)).limit(1).count():
        raise ModelMismatch(f"{name}: version {version} is stored already")
    PipelineModel([FillValues(values=fitted.imputer.values), *fitted.model.stages]).write().overwrite().save(
        f"{folder}/models/{name}/{version}")
    seen = train.agg(F.count(F.lit(1)), F.sum(F.col(target).cast("bigint")), F.min(date_col), F.max(date_col)).first()
    record = spark.createDataFrame([([(c, types[c]) for c in columns], target, float(threshold), *seen, name, version)], RECORD)
    replace_partitions(record, folder + "/records", ["name", "version"])
    return record.first()


def records(spark: SparkSession, folder: str) -> DataFrame | None:
    """One row for each stored model and version."""
    try:
        return spark.read.schema(RECORD).parquet(folder + "/records")
    except AnalysisException:
        return None


@dataclass(frozen=True)
class StoredModel:
    """A loaded pipeline with its record."""

    model: PipelineModel
    record: Row

    @property
    def columns(self) -> list[str]:
        return [c["name"] for c in self.record["columns"]]

    def check(self, df: DataFrame) -> None:
        types = dict(df.dtypes)
        wrong = [f"{c['name']} is {types.get(c['name'], 'missing')}, not {c['type']}" for c in self.record["columns"]
                 if types.get(c["name"]) != c["type"]]
        if wrong:
            raise ModelMismatch(f"{self.record['name']}: " + ", ".join(wrong))

    def score(self, df: DataFrame, out: str = "risk_probability") -> DataFrame:
        """Add the probability of the positive class. A score that is no probability fails the job that reads it."""
        self.check(df)
        s = self.model.transform(df).withColumn("__p", vector_to_array("probability")[1])
        bad = F.col("__p").isNull() | F.isnan("__p") | ~F.col("__p").between(0, 1)
        p = F.when(bad, F.raise_error(F.lit(f"{self.record['name']}: score is no probability")).cast("double")).otherwise(F.col("__p"))
        return drop_helpers(s.withColumn(out, p)).drop("__p").select(*df.columns, out)


def load_model(spark: SparkSession, folder: str, name: str, version: int | None = None,
               columns: Sequence[str] | None = None) -> StoredModel:
    """The newest version, or the one named. With ``columns``, fails if the model was trained on others or in another order."""
    known = records(spark, folder)
    found = [] if known is None else known.filter(F.col("name") == name).filter(
        F.lit(True) if version is None else F.col("version") == version).orderBy(F.desc("version")).take(1)
    if not found:
        raise ModelMismatch(f"{name}: no stored version {'' if version is None else version}".rstrip())
    record = found[0]
    own = [c["name"] for c in record["columns"]]
    if columns is not None and list(columns) != own:
        raise ModelMismatch(f"{name}: trained on {own}, asked with {list(columns)}")
    return StoredModel(PipelineModel.load(f"{folder}/models/{name}/{record['version']}"), record)
