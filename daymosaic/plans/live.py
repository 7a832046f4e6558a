"""The daily live path: features at the newest day, scoring, history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymosaic.functions.calendar import day_of_season
from daymosaic.functions.text import risk_label
from daymosaic.operators import lags as L
from daymosaic.operators import panel as P
from daymosaic.operators import quality as Q
from daymosaic.operators.cleaning import latest
from daymosaic.operators.joins import seasonal_prior, upsert
from daymosaic.operators.sets import union

KEYS = ["region", "entity"]
HISTORY_KEY = ["prediction_date", "region", "entity"]
HISTORY_FEATURES = {"event_mean_3d": 3, "event_mean_7d": 7}
NEEDED_DAYS = 8

Scorer = Callable[[DataFrame], DataFrame]


def live_panel(entities: DataFrame, history: DataFrame, live: DataFrame, dates: Column) -> DataFrame:
    """Sparse history and live counts on a dense calendar; live replaces equal keys."""
    day = [*KEYS, "date"]
    kept = history.select(*day, "event_count").join(live.select(*day), day, "left_anti")
    counts = union(kept, live.select(*day, "event_count"))
    return P.zero_fill(P.skeleton(entities, KEYS, dates), counts, day, ["event_count"])


def live_features(panel: DataFrame) -> DataFrame:
    """Row lags (1, 3, 7) and full-window means, restarted every year."""
    p = panel.withColumn("year", F.year("date"))
    by = [*KEYS, "year"]
    f = L.lag_rows(p, by, {"event_count": "event"})
    return L.rolling_mean_prev(f, by, "event_count", HISTORY_FEATURES)


def readiness(panel: DataFrame, needed: int = NEEDED_DAYS) -> DataFrame:
    """checks: panel complete, and each entity has enough unbroken days."""
    h = P.continuous_history(panel, KEYS, needed)
    short = h.agg(F.count_if(~F.col("ready")).alias("entities_not_ready"))
    return Q.all_checks(Q.complete_panel(panel, KEYS), Q.zero(short, ["entities_not_ready"]))


def scoring_rows(features: DataFrame, prior_history: DataFrame, forecast: DataFrame,
                 offset_days: int = 1, fill: Sequence[str] = ("event_lag_7d", "event_mean_7d")) -> DataFrame:
    """Newest feature rows, gaps filled from the seasonal mean, with the side
    values of the predicted day.

    ``offset_days`` is the distance from the feature day to the side-series day
    (1 as served; 0 pairs the same day, as trained).
    """
    now = latest(features, "date").withColumn("prediction_date", F.date_add("date", 1))
    now = now.withColumn("day_of_season", day_of_season("prediction_date"))
    prior = prior_history.withColumn("day_of_season", day_of_season("date"))
    filled = seasonal_prior(now, prior, [*KEYS, "day_of_season"], list(fill))
    side = forecast.withColumnRenamed("date", "_side_date")
    return (filled.withColumn("_side_date", F.date_add("date", offset_days))
            .join(side, [*KEYS, "_side_date"], "left").drop("_side_date"))


def score_live(rows: DataFrame, scorer: Scorer, threshold: float, required: Sequence[str]) -> DataFrame:
    """Predictions for rows whose features are complete."""
    ready = rows.dropna(subset=list(required))
    scored = scorer(ready).withColumn("risk_label", risk_label("risk_probability", threshold))
    mode = F.when(F.coalesce(F.col("filled_event_lag_7d"), F.lit(False)), "Warm-start").otherwise("Standard")
    return scored.withColumn("prediction_mode", mode)


def update_history(history: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(history, new, HISTORY_KEY)


def not_predicted(entities: DataFrame, predictions: DataFrame) -> DataFrame:
    """Entities without a prediction."""
    return entities.select(*KEYS).distinct().join(predictions.select(*KEYS), KEYS, "left_anti")


def season_span(start: dt.date, end: dt.date) -> Column:
    return F.sequence(F.lit(start), F.lit(end))
