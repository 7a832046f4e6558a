"""User-level queries over the prediction history.

A day holds few rows, so the history is laid out by year and sorted by date
inside: one directory per date would be mostly tiny files.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.functions.text import ELEVATED, NORMAL, norm_lower
from daymosaic.operators import quality as Q
from daymosaic.operators.cleaning import latest, require_columns, search, to_records
from daymosaic.operators.history import history_order, dashboard_summary, tracker_summary
from daymosaic.operators.ranking import dates_desc
from daymosaic.sources.sinks import write_table

COLUMNS = ["prediction_date", "region", "entity", "risk_probability", "risk_label"]
KEY = ["prediction_date", "region", "entity"]


class NoPredictions(LookupError):
    """Raised when a request finds no predictions."""


def found(df: DataFrame) -> DataFrame:
    """The rows, or an error when there are none (reads at most one row)."""
    if df.isEmpty():
        raise NoPredictions("no predictions are available")
    return df


def latest_predictions(predictions: DataFrame) -> DataFrame:
    return to_records(latest(predictions, "prediction_date"))


def predictions_on(history: DataFrame, day: dt.date) -> DataFrame:
    """One date. The year prunes directories, the date skips row groups."""
    hit = F.col("prediction_date") == F.lit(day)
    if "year" in history.columns:
        hit = hit & (F.col("year") == day.year)
    return to_records(history.filter(hit))


def write_history(predictions: DataFrame, path: str) -> str:
    return write_table(predictions.withColumn("year", F.year("prediction_date")), path, ["year"],
                       sort_by=["prediction_date"])


def prediction_dates(history: DataFrame) -> DataFrame:
    return dates_desc(history, "prediction_date")


def entity_prediction(predictions: DataFrame, name: str) -> DataFrame:
    return to_records(search(predictions, name, ["entity"], exact=True))


def filter_predictions(predictions: DataFrame, label: str | None = None,
                       text: str | None = None) -> DataFrame:
    """By risk label and by text in region or entity."""
    out = predictions if label in (None, "All") else predictions.filter(F.col("risk_label") == label)
    return out if not text else search(out, text, ["region", "entity"])


def with_map_key(predictions: DataFrame) -> DataFrame:
    """region|entity in lower case: the key of a map layer."""
    return predictions.withColumn("map_key", F.concat_ws("|", norm_lower("region"), norm_lower("entity")))


def tracker_view(tracker: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records oldest first and most probable first, and the summary."""
    return to_records(tracker.orderBy(*history_order())), tracker_summary(tracker)


def summary(predictions: DataFrame) -> DataFrame:
    return dashboard_summary(predictions)


def validate(predictions: DataFrame, year: int | None = None) -> DataFrame:
    """checks on a prediction table: dates, probabilities, labels, keys, year."""
    require_columns(predictions, COLUMNS, "predictions")
    p = F.col("risk_probability").try_cast("double")
    day = F.col("prediction_date").try_cast("date")
    aggs = {"invalid_dates": day.isNull(), "invalid_probabilities": p.isNull() | F.isnan(p),
            "probabilities_out_of_range": (p < 0) | (p > 1),
            "invalid_labels": F.col("risk_label").isNotNull() & ~F.col("risk_label").isin(NORMAL, ELEVATED)}
    if year is not None:
        aggs["other_years"] = F.year(day) != year
    one = predictions.agg(*[F.count_if(t).alias(n) for n, t in aggs.items()])
    return Q.all_checks(Q.zero(one, list(aggs)), Q.unique_key(predictions, KEY))
