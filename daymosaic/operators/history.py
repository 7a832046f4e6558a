"""Prediction history, verification against later counts, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymosaic.functions.numeric import ratio_or_null, ratio_or_zero
from daymosaic.functions.text import (CORRECT, ELEVATED, ERROR_NAMES, INCORRECT, NORMAL, PENDING,
                                      choose)

KEYS = ["prediction_date", "region", "entity"]


def verify_predictions(predictions: DataFrame, actuals: DataFrame, threshold: float = 2.0,
                       observed: DataFrame | None = None) -> DataFrame:
    """Predictions left join actual counts, with label, status and error type.

    ``actuals`` holds (date, region, entity, event_count) for days with events.
    A prediction without a row stays Pending, because a missing row may mean
    "no data". With ``observed`` (date, region, entity known to be observed) a
    missing row there counts as zero events.
    """
    a = actuals.select(F.col("date").alias("prediction_date"), "region", "entity",
                       F.col("event_count").alias("actual_count"))
    out = predictions.join(a, KEYS, "left")
    if observed is not None:
        seen = observed.select(F.col("date").alias("prediction_date"), "region", "entity",
                               F.lit(True).alias("_seen")).distinct()
        out = out.join(seen, KEYS, "left").withColumn(
            "actual_count", F.coalesce("actual_count", F.when(F.col("_seen"), F.lit(0)))).drop("_seen")
    n = F.col("actual_count")
    actual = F.when(n > threshold, ELEVATED).when(n.isNotNull(), NORMAL)
    said = F.col("risk_label")
    status = F.when(actual.isNull(), PENDING).when(said == actual, CORRECT).otherwise(INCORRECT)
    pair = lambda s, t: (said == s) & (actual == t)
    error = choose([(actual.isNull(), PENDING), (pair(ELEVATED, ELEVATED), ERROR_NAMES["TP"]),
                    (pair(NORMAL, NORMAL), ERROR_NAMES["TN"]),
                    (pair(ELEVATED, NORMAL), ERROR_NAMES["FP"]),
                    (pair(NORMAL, ELEVATED), ERROR_NAMES["FN"])], "Unknown")
    return out.withColumns({"actual_risk": actual, "verification_status": status,
                            "error_type": error})


def tracker_summary(tracker: DataFrame) -> DataFrame:
    """Totals, coverage and verified accuracy (NULL while nothing is verified)."""
    s = F.coalesce(F.col("verification_status"), F.lit(PENDING))
    return tracker.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == PENDING).alias("pending"),
        F.count_if(s != PENDING).alias("verified"), F.count_if(s == CORRECT).alias("correct"),
        F.count_if(s == INCORRECT).alias("incorrect"),
    ).withColumns({
        "verification_coverage": F.round(ratio_or_zero("verified", "total"), 4),
        "verified_accuracy": F.round(ratio_or_null("correct", "verified"), 4)})


def dashboard_summary(predictions: DataFrame) -> DataFrame:
    """Totals by label and the row with the highest probability (first by name on ties)."""
    top = F.max_by(F.struct("region", "entity", "risk_probability", "risk_label"),
                   F.struct(F.col("risk_probability"), _reverse("entity")))
    return predictions.agg(
        F.max("prediction_date").alias("prediction_date"), F.count(F.lit(1)).alias("total_entities"),
        F.count_if(F.col("risk_label") == NORMAL).alias("normal_count"),
        F.count_if(F.col("risk_label") == ELEVATED).alias("elevated_count"), top.alias("t"),
    ).select("prediction_date", "total_entities", "normal_count", "elevated_count",
             F.col("t.entity").alias("highest_risk_entity"),
             F.col("t.region").alias("highest_risk_region"),
             F.col("t.risk_probability").alias("highest_risk_probability"),
             F.col("t.risk_label").alias("highest_risk_label"))


def _reverse(name: str) -> Column:
    """Sort key that prefers the smaller name under max_by: negated code points,
    closed by a mark above all of them so that a prefix counts as smaller."""
    codes = F.transform(F.split(F.col(name), ""), lambda ch: -F.ascii(ch))
    return F.concat(codes, F.array(F.lit(1)))


def history_order() -> list[Column]:
    """Oldest date first, most probable first within a date."""
    return [F.col("prediction_date"), F.col("risk_probability").desc(), F.col("region"), F.col("entity")]
