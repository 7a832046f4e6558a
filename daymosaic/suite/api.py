"""User-level queries on the derived prediction history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daymosaic.plans import api
from daymosaic.session import run_folder
from daymosaic.suite.base import KEYS, query
from daymosaic.suite.live import SPARSE, predictions, tracker

REC = "strftime(prediction_date, '%Y-%m-%d') AS prediction_date, region, entity, risk_probability, risk_label"


@query("api_latest", f"""SELECT {REC} FROM predicted
  WHERE predicted.prediction_date = (SELECT max(prediction_date) FROM predicted)""")
def api_latest(spark, d):
    return api.latest_predictions(predictions(spark, d))


@query("api_by_date", f"SELECT {REC} FROM predicted WHERE predicted.prediction_date = DATE '1998-10-17'")
def api_by_date(spark, d):
    """From the history on disk: one year's directory is read."""
    path = run_folder(spark, "predictions")
    api.write_history(predictions(spark, d), path)
    return api.predictions_on(spark.read.parquet(path), dt.date(1998, 10, 17)).select(
        "prediction_date", *KEYS, "risk_probability", "risk_label")


@query("api_dates", "SELECT DISTINCT prediction_date FROM predicted")
def api_dates(spark, d):
    return api.prediction_dates(predictions(spark, d))


@query("api_entity", f"SELECT {REC} FROM predicted WHERE lower(entity) = 'nation_7'")
def api_entity(spark, d):
    return api.entity_prediction(predictions(spark, d), " Nation_7 ")


@query("api_filter", """SELECT prediction_date, region, entity, risk_probability, risk_label,
  lower(region) || '|' || lower(entity) AS map_key FROM predicted WHERE risk_label = 'Elevated'
  AND (lower(region) LIKE '%asia%' OR lower(entity) LIKE '%asia%')""")
def api_filter(spark, d):
    return api.with_map_key(api.filter_predictions(predictions(spark, d), "Elevated", "Asia"))


@query("api_tracker", f"""WITH {SPARSE} SELECT strftime(prediction_date, '%Y-%m-%d') AS prediction_date, region,
  entity, risk_probability, risk_label, actual_count, actual_risk, verification_status, error_type FROM t""")
def api_tracker(spark, d):
    return api.tracker_view(tracker(spark, d))[0]


@query("api_validate", """SELECT name, v = 0 AS passed, CAST(v AS VARCHAR) AS detail FROM (
  SELECT 'invalid_dates' AS name, count(*) FILTER (WHERE prediction_date IS NULL) AS v FROM predicted
  UNION ALL SELECT 'invalid_probabilities', count(*) FILTER (WHERE risk_probability IS NULL) FROM predicted
  UNION ALL SELECT 'probabilities_out_of_range', count(*) FILTER (WHERE risk_probability NOT BETWEEN 0 AND 1)
    FROM predicted
  UNION ALL SELECT 'invalid_labels', count(*) FILTER (WHERE risk_label NOT IN ('Normal', 'Elevated')) FROM predicted
  UNION ALL SELECT 'other_years', count(*) FILTER (WHERE year(prediction_date) <> 2000) FROM predicted
  UNION ALL SELECT 'unique_key', count(*) - count(DISTINCT (prediction_date, region, entity)) FROM predicted)""")
def api_validate(spark, d):
    return api.validate(predictions(spark, d), year=2000)
