"""Entity x date skeletons, zero filling, event aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT_METRICS = ("event_count", "high_count", "day_count", "night_count")
SUM_METRICS = ("measure_sum",)
MEAN_METRICS = ("measure_mean", "measure_max", "bright_a_mean", "bright_a_max", "bright_b_mean")


def skeleton(entities: DataFrame, keys: Sequence[str], dates: Column,
             date_col: str = "date") -> DataFrame:
    """Every entity on every date of an array literal.

    The dates are unpacked inside each entity row, so there is no cross join
    and the result keeps the entity's partitioning.
    """
    return entities.select(*keys).distinct().select(*keys, F.explode(dates).alias(date_col))


def zero_fill(skel: DataFrame, observed: DataFrame, keys: Sequence[str],
              fill: Sequence[str] | Mapping[str, object]) -> DataFrame:
    """Skeleton left join observed; the named metrics become zero, others stay NULL."""
    if not isinstance(fill, Mapping):
        types = dict(observed.dtypes)
        fill = {c: 0.0 if types[c] in ("double", "float") else 0 for c in fill}
    return skel.join(observed, list(keys), "left").fillna(dict(fill))


def daily_count(events: DataFrame, keys: Sequence[str], out: str = "event_count") -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def event_metrics(events: DataFrame, keys: Sequence[str], measure: str = "measure",
                  high: Column | None = None, day: Column | None = None,
                  night: Column | None = None, bright_a: str = "bright_a",
                  bright_b: str = "bright_b") -> DataFrame:
    """Counts, measure statistics and brightness statistics per key.

    Only mergeable aggregates, so each task sends at most one row per key.
    """
    high = F.col("is_high") if high is None else high
    day = F.col("is_day") if day is None else day
    night = F.col("is_night") if night is None else night
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(measure).alias("measure_sum"),
        F.avg(measure).alias("measure_mean"),
        F.max(measure).alias("measure_max"),
        F.count_if(high).alias("high_count"),
        F.count_if(day).alias("day_count"),
        F.count_if(night).alias("night_count"),
        F.avg(bright_a).alias("bright_a_mean"),
        F.max(bright_a).alias("bright_a_max"),
        F.avg(bright_b).alias("bright_b_mean"),
    )


def cell_rollup(cell_days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cell-day rows to entity-day: active cells, largest cell, concentration."""
    out = cell_days.groupBy(*keys).agg(
        F.count_if(F.col("event_count") > 0).alias("active_cell_count"),
        F.max("event_count").alias("max_cell_event_count"),
        F.max("measure_sum").alias("max_cell_measure"),
        F.sum("event_count").alias("cell_event_count_sum"),
    )
    return out.withColumn("max_cell_share", F.when(
        F.col("cell_event_count_sum") > 0,
        F.col("max_cell_event_count") / F.col("cell_event_count_sum")).otherwise(F.lit(0.0)))


def weighted_split(cell_counts: DataFrame, weights: DataFrame, cell_key: str,
                   out_keys: Sequence[str], count: str = "event_count",
                   weight: str = "area_weight", out: str = "event_count_weighted") -> DataFrame:
    """Spread each cell's count over its entities by weight."""
    return (cell_counts.join(weights, cell_key)
            .groupBy(*out_keys).agg(F.sum(F.col(count) * F.col(weight)).alias(out)))


def year_totals(panel: DataFrame, value: str = "event_count", date_col: str = "date") -> DataFrame:
    return panel.groupBy(F.year(date_col).alias("year")).agg(F.sum(value).alias("total"))


def missing_dates(series: DataFrame, keys: Sequence[str], date_col: str = "date") -> DataFrame:
    """Calendar dates absent between each key's first and last date.

    Each present date looks at the next one; only the gaps are unpacked.
    """
    from pyspark.sql import Window

    days = series.select(*keys, date_col).distinct()
    nxt = F.lead(date_col).over(Window.partitionBy(*keys).orderBy(date_col))
    gaps = days.withColumn("_next", nxt).filter(F.datediff("_next", date_col) > 1)
    return gaps.select(*keys, F.explode(F.sequence(
        F.date_add(date_col, 1), F.date_sub("_next", 1))).alias(date_col))


def continuous_history(series: DataFrame, keys: Sequence[str], needed: int = 8,
                       date_col: str = "date") -> DataFrame:
    """Per key: days present, days spanned, gap days, and whether enough are unbroken."""
    return (series.groupBy(*keys)
            .agg(F.count_distinct(date_col).alias("days_present"),
                 F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))
            .withColumn("days_spanned", F.datediff("last_date", "first_date") + 1)
            .withColumn("gap_days", F.col("days_spanned") - F.col("days_present"))
            .withColumn("ready", (F.col("gap_days") == 0) & (F.col("days_present") >= needed)))
