"""Streams that keep their state in Spark's state store: rolling features by entity, predictions joined with counts.

``RollingFeatures`` in ``live`` keeps counts in tables and reads them again for each batch. Here every entity holds a ring of
its newest days in keyed state, so a batch touches the entities in it alone, and timers empty the rings of quiet ones.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from daymosaic.streaming.live import BATCH, _append_batch

#: The state store that keyed state and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
LAGS, MEANS = (1, 3, 7), (3, 7)
EPOCH = dt.date(1970, 1, 1)


def use_state_store(spark: SparkSession) -> None:
    """Sessions that run keyed state name a store which supports it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class RollingProcessor(StatefulProcessor):
    """Day counts of one entity: a ring of its newest ``keep`` days, and its first and last day.

    New counts change the features of their own day and of the ``reach`` days after it. Days between the former last
    day and a new one had no events; they come out too. Counts for a day so old that the days before it have left the
    ring are ignored: the watermark refuses them anyway.
    """

    def __init__(self, reach: int, keep: int):
        self.reach, self.keep = reach, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "n bigint")
        self.span = handle.getValueState("span", "first int, last int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = Counter()
        for r in rows:
            new[r["day"]] += r["n"]
        span = self.span.get()
        former, last = (span[0], span[1]) if span is not None else (min(new), min(new) - 1)
        new = {d: n for d, n in new.items() if d > last - self.keep + self.reach}
        if not new:
            return iter(())
        first, end = min(former, *new), max(last, *new)
        ring = {k[0]: v[0] for k, v in self.days.iterator()}
        for d, n in new.items():
            ring[d] = ring.get(d, 0) + n
        for d, n in ring.items():
            if d > end - self.keep:
                if d in new:
                    self.days.updateValue((d,), (n,))
            elif self.days.containsKey((d,)):
                self.days.removeKey((d,))
        self.span.update((first, end))
        self.handle.registerTimer((end + 1 + self.keep) * DAY_MS)
        changed = max(max(new), former if first < former else 0) + self.reach
        upto = end if end > last else min(end, changed)
        return iter([self._features(key, d, ring, first) for d in range(min(last + 1, *new), upto + 1)])

    def _features(self, key, day: int, ring: dict[int, int], first: int) -> Row:
        def count(d):
            return ring.get(d, 0) if d >= first else None
        means = {f"event_mean_{m}d": sum(count(day - k) for k in range(1, m + 1)) / m if day - m >= first else None for m in MEANS}
        return Row(region=key[0], entity=key[1], date=EPOCH + dt.timedelta(days=day), event_count=count(day),
                   **{f"event_lag_{k}d": count(day - k) for k in LAGS}, **means)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """An entity without events for ``keep`` days holds no more than the days that the next ones look back to."""
        span = self.span.get()
        if span is not None and (span[1] + 1 + self.keep) * DAY_MS <= expiredTimerInfo.getExpiryTimeInMs():
            for d in [k[0] for k in self.days.keys()]:
                if d <= span[1] - self.reach:
                    self.days.removeKey((d,))
        return iter(())

    def close(self) -> None:
        pass


FEATURES = ("region string, entity string, date date, event_count bigint, event_lag_1d bigint, event_lag_3d bigint, event_lag_7d bigint, "
            "event_mean_3d double, event_mean_7d double")


def rolling_features(events: DataFrame, time_col: str = "ts", delay: str = "2 days", reach: int = 7, late_days: int = 2) -> DataFrame:
    """Feature rows of the touched days, from events with region and entity, in keyed state.

    A ring holds the days that late events may still change and the ``reach`` days before them. Events past ``delay`` are
    refused by the watermark. Rows of one batch replace those of earlier batches for the same day.
    """
    use_state_store(events.sparkSession)
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    day = F.datediff(F.to_date(time_col), F.lit(EPOCH))
    rows = timed.select("region", "entity", time_col, day.alias("day"), F.lit(1).cast("bigint").alias("n"))
    # a day may come 2 * reach after the one it changes: its own features need the reach before it
    keep = 2 * reach + late_days + 1
    return rows.groupBy("region", "entity").transformWithState(
        RollingProcessor(reach, keep), outputStructType=FEATURES, outputMode="Update", timeMode="EventTime")


@dataclass(frozen=True)
class KeepNewest:
    """A foreachBatch step that stores rows by batch; ``rows`` gives the newest version of each key."""

    folder: str
    keys: Sequence[str] = ("region", "entity", "date")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        _append_batch(batch, self.folder + "/rows", batch_id)

    @property
    def checkpoint_path(self) -> str:
        return self.folder + "/checkpoint"

    def rows(self, spark: SparkSession) -> DataFrame:
        f = spark.read.parquet(self.folder + "/rows")
        rest = [c for c in f.columns if c not in (*self.keys, BATCH)]
        best = f.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_r"))
        return best.select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def join_counts(predictions: DataFrame, counts: DataFrame, delay: str = "2 days", within: str = "1 day") -> DataFrame:
    """Left outer join of two streams: predictions with the counts of their day.

    ``predictions`` has prediction_time, region, entity and more; ``counts`` has count_time, region, entity and
    event_count. A count belongs to a prediction if its time is at or after the prediction's and less than ``within`` later. A
    prediction that has no count when the watermark of both streams has passed the end of that span comes out with a NULL count.
    """
    p = predictions.withWatermark("prediction_time", delay).alias("p")
    c = counts.withWatermark("count_time", delay).select(
        F.col("region").alias("_region"), F.col("entity").alias("_entity"), "count_time", "event_count").alias("c")
    same = ((F.col("region") == F.col("_region")) & (F.col("entity") == F.col("_entity"))
            & (F.col("count_time") >= F.col("prediction_time"))
            & (F.col("count_time") < F.col("prediction_time") + F.expr(f"INTERVAL {within}")))
    return p.join(c, same, "leftOuter").drop("_region", "_entity", "count_time")
