"""foreachBatch steps: rolling features, scoring, verification.

Each step writes to folders named by batch id, so that a batch replayed after
a failure overwrites its own output and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymosaic.operators import lags as L
from daymosaic.operators.history import verify_predictions
from daymosaic.operators.joins import upsert
from daymosaic.plans.live import HISTORY_FEATURES, Scorer
from daymosaic.session import materialise_at, remove_folder, run_folder
from daymosaic.sources.sinks import replace_partitions

BATCH = "batch_id"


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    replace_partitions(df.withColumn(BATCH, F.lit(batch_id)), path, [BATCH])


@dataclass(frozen=True)
class RollingFeatures:
    """Keeps per-batch daily counts and writes features of the touched entities.

    A late event changes the lags of later days, so features are recomputed
    for every entity in the batch over the days that its events can reach.

    Counts are stored by batch id. Every ``compact_every`` batches they are
    summed into a base table, so that a batch reads the base and the few
    batches since, of the entities it touches. A replayed batch writes the same
    tables again. The stream's checkpoint belongs to this folder: pass
    ``checkpoint_path`` to ``run_batches``.
    """

    folder: str
    keys: Sequence[str] = ("region", "entity")
    reach_days: int = 7
    time_col: str = "ts"
    compact_every: int = 50

    @property
    def counts_path(self) -> str:
        return self.folder + "/counts"

    @property
    def features_path(self) -> str:
        return self.folder + "/features"

    @property
    def checkpoint_path(self) -> str:
        return self.folder + "/checkpoint"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        day = batch.groupBy(*self.keys, F.to_date(self.time_col).alias("date")).agg(
            F.count(F.lit(1)).alias("event_count"))
        _append_batch(day, self.counts_path, batch_id)
        touched = batch.select(*self.keys).distinct()
        seen = self._known(batch.sparkSession, batch_id).join(touched, list(self.keys), "left_semi")
        panel = self._dense(seen, self._spans(seen, batch_id))
        f = L.lag_days(panel, self.keys, {"event_count": "event"}, (1, 3, 7))
        f = L.rolling_mean_prev(f, self.keys, "event_count", HISTORY_FEATURES)
        _append_batch(f.filter(F.col("date") >= F.col("_from")).drop("_from"), self.features_path, batch_id)

    def _known(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Counts up to a batch: the base below it and the batches since."""
        start = batch_id // self.compact_every * self.compact_every
        recent = self.counts(spark).filter(F.col(BATCH).between(start, batch_id))
        if start == 0:
            return recent
        base = f"{self.folder}/base-{start}"
        if batch_id == start:
            (self._known(spark, start - 1).groupBy(*self.keys, "date")
             .agg(F.sum("event_count").alias("event_count"))
             .withColumn(BATCH, F.lit(start - 1)).write.mode("overwrite").parquet(base))
        return recent.unionByName(spark.read.parquet(base))

    def _spans(self, seen: DataFrame, batch_id: int) -> DataFrame:
        """Per touched entity the days to emit: _from .. _to, and its first day.

        Besides the days near the batch's events these are the empty days that
        became known: after the former last day, or before the former first.
        """
        new, old = F.col(BATCH) == batch_id, F.col(BATCH) < batch_id
        pick = lambda agg, test: agg(F.when(test, F.col("date")))
        s = seen.groupBy(*self.keys).agg(
            F.min("date").alias("_first"), F.max("date").alias("_last"),
            pick(F.min, new).alias("_lo"), pick(F.max, new).alias("_hi"),
            pick(F.min, old).alias("_old_first"), pick(F.max, old).alias("_old_last"),
        ).filter(F.col("_lo").isNotNull())
        start = F.least("_lo", F.coalesce(F.date_add("_old_last", 1), F.col("_lo")))
        end = F.greatest("_hi", F.coalesce(F.when(F.col("_lo") < F.col("_old_first"), F.col("_old_first")),
                                           F.col("_hi")))
        return s.select(*self.keys, "_first", start.alias("_from"),
                        F.least("_last", F.date_add(end, self.reach_days)).alias("_to"))

    def _dense(self, seen: DataFrame, spans: DataFrame) -> DataFrame:
        """Counts of the spans and of the days their lags reach back to, zero where empty."""
        back = F.greatest("_first", F.date_sub("_from", self.reach_days))
        earliest = spans.agg(F.date_sub(F.min("_from"), self.reach_days)).scalar()
        daily = (seen.filter(F.col("date") >= earliest)
                 .groupBy(*self.keys, "date").agg(F.sum("event_count").alias("event_count")))
        skel = spans.select(*self.keys, "_from", F.explode(F.sequence(back, F.col("_to"))).alias("date"))
        return skel.join(daily, [*self.keys, "date"], "left").fillna({"event_count": 0})

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.counts_path)

    def features(self, spark: SparkSession) -> DataFrame:
        """The newest version of each entity-day."""
        f = spark.read.parquet(self.features_path)
        rest = [c for c in f.columns if c not in (*self.keys, "date", BATCH)]
        best = f.groupBy(*self.keys, "date").agg(F.max_by(F.struct(*rest), BATCH).alias("_r"))
        return best.select(*self.keys, "date", *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_table(new: DataFrame, path: str, keys: Sequence[str], partition: str) -> None:
    """Upsert into a partitioned table, rewriting only the touched partitions.

    The merged rows are written aside first, as the partitions being replaced
    are also being read; what was written aside is removed afterwards.
    """
    spark = new.sparkSession
    aside = run_folder(spark, "upsert")
    new = materialise_at(new, aside + "/new")
    table = _read_if_there(spark, path)
    if table is not None:
        old = table.join(new.select(partition).distinct(), partition, "left_semi")
        new = materialise_at(upsert(old, new, keys), aside + "/merged")
    replace_partitions(new, path, [partition])
    remove_folder(spark, aside)


@dataclass(frozen=True)
class ScoreStream:
    """Scores each batch of feature rows and upserts the prediction history."""

    path: str
    scorer: Scorer
    keys: Sequence[str] = ("prediction_date", "region", "entity")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = self.scorer(batch.withColumn("prediction_date", F.date_add("date", 1)))
        upsert_table(rows.select(*self.keys, "risk_probability", "risk_label"), self.path, self.keys,
                     "prediction_date")


@dataclass(frozen=True)
class VerifyStream:
    """Joins arriving counts to the history; other predictions stay Pending.

    A batch touches the predictions whose counts it holds and no others, so a
    day may arrive in any number of batches.
    """

    history_path: str
    tracker_path: str
    keys: Sequence[str] = ("prediction_date", "region", "entity")
    threshold: float = 2.0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        history = batch.sparkSession.read.parquet(self.history_path)
        here = batch.select(F.col("date").alias("prediction_date"), *self.keys[1:]).distinct()
        due = history.join(here, list(self.keys), "left_semi")
        upsert_table(verify_predictions(due, batch, self.threshold), self.tracker_path, self.keys,
                     "prediction_date")

    def tracker(self, spark: SparkSession) -> DataFrame:
        """Verified rows and, as Pending, every prediction not yet reached."""
        history = spark.read.parquet(self.history_path)
        done = _read_if_there(spark, self.tracker_path)
        if done is None:
            none = spark.createDataFrame([], "date date, region string, entity string, event_count bigint")
            return verify_predictions(history, none, self.threshold)
        nothing = done.select(F.col("prediction_date").alias("date"), "region", "entity",
                              F.col("actual_count").alias("event_count")).filter(F.lit(False))
        waiting = verify_predictions(history.join(done.select(*self.keys), list(self.keys), "left_anti"),
                                     nothing, self.threshold)
        return done.unionByName(waiting)
