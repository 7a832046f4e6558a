"""File streams of events: de-duplication, daily counts, late rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daymosaic.session import run_folder
from daymosaic.sources.sinks import replace_partitions

OVERLAP = "2 days"


def event_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                 files_per_trigger: int | None = None, name_filter: str | None = None) -> DataFrame:
    """Files appearing below a path, as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(path)


def _event_time(stream: DataFrame, time_col: str) -> DataFrame:
    """Watermarks need an instant; a zone-less time is read in the session's zone (UTC)."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp"))


def ingest(stream: DataFrame, keys: Sequence[str], time_col: str = "ts",
           delay: str = OVERLAP) -> DataFrame:
    """First copy of each natural key; copies re-read in the overlap are dropped.

    State holds the keys of the last ``delay`` of event time only.
    """
    return _event_time(stream, time_col).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def daily_counts(stream: DataFrame, keys: Sequence[str], time_col: str = "ts",
                 delay: str | None = OVERLAP) -> DataFrame:
    """Events per key and day. In append mode a day comes out once, when the
    watermark has passed its end; in update mode it comes out on every change."""
    stream = _event_time(stream, time_col)
    if delay is not None:
        stream = stream.withWatermark(time_col, delay)
    return (stream.groupBy(F.window(time_col, "1 day").alias("_w"), *keys)
            .agg(F.count(F.lit(1)).alias("event_count"))
            .select(F.to_date("_w.start").alias("date"), *keys, "event_count"))


def run_to_table(stream: DataFrame, label: str, mode: str = "append", path: str | None = None,
                 checkpoint: str | None = None) -> tuple[str, StreamingQuery]:
    """Drain the available input into a Parquet table; returns its path and the query.

    A later call with the same ``path`` and ``checkpoint`` goes on where the
    last one ended. Without them the run starts from nothing in a new folder.
    """
    path = path or run_folder(stream.sparkSession, label)
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", checkpoint or path + "-state").option("path", path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return path, q


def run_batches(stream: DataFrame, label: str, step: Callable[[DataFrame, int], None],
                mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Drain the available input through a foreachBatch step.

    Batch ids come from the checkpoint. A step that keeps state by batch id needs
    the same ``checkpoint`` in every run; keep it beside that state.
    """
    q = (stream.writeStream.foreachBatch(step).outputMode(mode)
         .option("checkpointLocation", checkpoint or run_folder(stream.sparkSession, label + "-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


@dataclass(frozen=True)
class LateRows:
    """A foreachBatch step that keeps late rows instead of dropping them.

    The line of a batch is the newest event time of all batches before it, less ``delay_days``. A row whose day had ended
    by then is refused and stored apart, with its batch; other rows are accepted. Each batch leaves a record of its
    counts and its newest time, from which later batches take their line, so a replayed batch judges its rows as it did before. The
    stream's checkpoint belongs to this folder: pass ``checkpoint_path`` to ``run_batches``.
    """

    folder: str
    time_col: str = "ts"
    delay_days: int = 2

    @property
    def checkpoint_path(self) -> str:
        return self.folder + "/checkpoint"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        line = F.lit(None).cast("timestamp")
        if batch_id:
            before = self.batches(spark).filter(F.col("batch_id") < batch_id)
            line = F.lit(before.agg(F.max("newest")).first()[0]) - F.expr(f"INTERVAL {self.delay_days} DAYS")
        closed = F.date_add(F.to_date(self.time_col), 1).cast("timestamp") <= line
        judged = batch.withColumn("refused", F.coalesce(closed, F.lit(False))).withColumn("batch_id", F.lit(batch_id))
        replace_partitions(judged, self.folder + "/rows", ["batch_id", "refused"])
        # counted on what was stored; an Observation would leave the session with a part that fitted models cannot travel with
        stored = spark.read.parquet(self.folder + "/rows").filter(F.col("batch_id") == batch_id)
        record = stored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("refused").cast("boolean")).alias("late"),
                            F.max(F.col(self.time_col).cast("timestamp")).alias("newest"), F.lit(batch_id).alias("batch_id"))
        replace_partitions(record, self.folder + "/batches", ["batch_id"])

    def accepted(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, False).drop("batch_id")

    def refused(self, spark: SparkSession) -> DataFrame:
        """The quarantined rows, with the batch that brought them."""
        return self._rows(spark, True)

    def _rows(self, spark: SparkSession, refused: bool) -> DataFrame:
        return spark.read.parquet(self.folder + "/rows").filter(F.col("refused").cast("boolean") == refused).drop("refused")

    def batches(self, spark: SparkSession) -> DataFrame:
        """batch_id, rows, late, newest: one record for each batch."""
        return spark.read.schema("rows bigint, late bigint, newest timestamp, batch_id int").parquet(self.folder + "/batches")
