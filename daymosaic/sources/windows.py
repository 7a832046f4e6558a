"""Request windows, window coverage, source spans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.functions.calendar import AUTUMN, Season

SUCCESS = "SUCCESS"


def seasonal_windows(years: DataFrame, length: int = 5, season: Season = AUTUMN) -> DataFrame:
    """(year, window_start, window_end): back-to-back windows, the last one clipped."""
    first = F.make_date("year", F.lit(season.start_month), F.lit(season.start_day))
    last = F.make_date("year", F.lit(season.end_month), F.lit(season.end_day))
    starts = F.expr(f"sequence(_first, _last, interval {int(length)} days)")
    return (years.select("year", first.alias("_first"), last.alias("_last"))
            .select("year", "_last", F.explode(starts).alias("window_start"))
            .select("year", "window_start",
                    F.least(F.date_add("window_start", length - 1), "_last").alias("window_end")))


def window_coverage(manifest: DataFrame) -> DataFrame:
    """Per source and year: requested, returned, failed windows and missing dates.

    The date list is bounded by the days of one season.
    """
    failed = F.col("status") != SUCCESS
    days = F.when(failed, F.sequence("requested_start", "requested_end"))
    out = manifest.groupBy("source", "year").agg(
        F.count(F.lit(1)).alias("requested_windows"),
        F.count_if(~failed).alias("returned_windows"),
        F.count_if(failed).alias("failed_windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(days)))).alias("_days"))
    return out.withColumn("missing_dates", F.array_join(F.transform(
        "_days", lambda d: F.date_format(d, "yyyy-MM-dd")), ";")).drop("_days")


def coverage_complete(summary: DataFrame, expected_windows: int) -> DataFrame:
    """One row: are all expected windows there and did all succeed?"""
    return summary.agg(
        F.sum("requested_windows").alias("requested"), F.sum("failed_windows").alias("failed")
    ).withColumn("complete", (F.col("requested") == expected_windows) & (F.col("failed") == 0))


def source_span_check(sources: DataFrame, availability: DataFrame, start: dt.date,
                      end: dt.date) -> DataFrame:
    """Does every wanted source cover the study span?

    ``sources`` holds (source); ``availability`` (source, min_date, max_date),
    in which a source must appear exactly once.
    """
    a = availability.groupBy("source").agg(
        F.count(F.lit(1)).alias("_n"), F.min("min_date").alias("_lo"), F.max("max_date").alias("_hi"))
    one = F.col("_n") == 1
    covers = F.coalesce(one & (F.col("_lo") <= F.lit(start)) & (F.col("_hi") >= F.lit(end)), F.lit(False))
    return sources.join(a, "source", "left").select(
        "source", F.lit(start).alias("study_start"), F.lit(end).alias("study_end"),
        F.when(one, F.col("_lo")).alias("available_min_date"),
        F.when(one, F.col("_hi")).alias("available_max_date"), covers.alias("covers_full_period"),
        F.when(~F.coalesce(one, F.lit(False)), "SOURCE_MISSING_OR_AMBIGUOUS")
        .when(covers, "OK").otherwise("INSUFFICIENT_DATE_RANGE").alias("status"))
