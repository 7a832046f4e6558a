"""Live features, scoring, history and verification on derived predictions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daymosaic.functions.numeric import sigmoid
from daymosaic.functions.text import risk_label
from daymosaic.modelling import learners as LN
from daymosaic.modelling import store as ST
from daymosaic.operators import history as H
from daymosaic.operators import lags as L
from daymosaic.plans import live as LV
from daymosaic.session import materialise, run_folder
from daymosaic.suite.base import DAY_KEYS, KEYS, define, entities, observed, panel, query, side, table

#: Days that come from the live feed; its first three are in the stored history too.
FEED, OVERLAP = 10, 3


def live_days(spark, d):
    """The season of the newest date: its first day, the feed's first day, and the newest day whose next is in the season."""
    day = F.col("l_shipdate").cast("date")
    last = table(spark, d, "lineitem").agg(F.max(F.when(F.month(day).isin(10, 11), day))).first()[0] or dt.date(1970, 10, 1)
    last = min(last, dt.date(last.year, 11, 29))
    return dt.date(last.year, 10, 1), last - dt.timedelta(days=FEED - 1), last


def live_panel(spark, d):
    start, live, end = live_days(spark, d)
    o = observed(spark, d).select(*DAY_KEYS, "event_count")
    hist = o.filter(F.col("date").between(F.lit(start), F.lit(live + dt.timedelta(days=OVERLAP - 1))))
    fresh = o.filter(F.col("date").between(F.lit(max(start, live)), F.lit(end)))
    return LV.live_panel(entities(spark, d), hist, fresh, LV.season_span(start, end))


define("liveday", """SELECT least(max(date), make_date(year(max(date)), 11, 29)) AS last FROM obs""", "obs")
define("livep", """SELECT region, entity, date, event_count FROM panel, liveday
  WHERE date BETWEEN make_date(year(last), 10, 1) AND last""", "panel", "liveday")
define("livef", """SELECT *, lag(event_count, 1) OVER w AS event_lag_1d, lag(event_count, 3) OVER w AS event_lag_3d,
    lag(event_count, 7) OVER w AS event_lag_7d, CASE WHEN count(*) OVER w3 = 3 THEN avg(event_count) OVER w3 END
      AS event_mean_3d, CASE WHEN count(*) OVER w7 = 7 THEN avg(event_count) OVER w7 END AS event_mean_7d
  FROM livep WINDOW w AS (PARTITION BY region, entity ORDER BY date),
    w3 AS (PARTITION BY region, entity ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
    w7 AS (PARTITION BY region, entity ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""", "livep")


@query("live_panel", "SELECT * FROM livep")
def live_panel_(spark, d):
    return live_panel(spark, d)


@query("live_features", "SELECT *, year(date)::INTEGER AS year FROM livef")
def live_features(spark, d):
    return LV.live_features(live_panel(spark, d))


@query("live_readiness", """WITH c AS (SELECT count(*) AS n, count(DISTINCT (region, entity)) AS e,
    count(DISTINCT date) AS d, count(DISTINCT (region, entity, date)) AS k FROM livep),
  r AS (SELECT count(*) AS v FROM (SELECT region, entity FROM livep GROUP BY ALL
    HAVING count(DISTINCT date) < 8 OR max(date) - min(date) + 1 <> count(DISTINCT date)))
  SELECT 'complete_panel' AS name, n = e * d AS passed, CAST(n - e * d AS VARCHAR) AS detail FROM c
  UNION ALL SELECT 'unique_key', n = k, CAST(n - k AS VARCHAR) FROM c
  UNION ALL SELECT 'entities_not_ready', v = 0, CAST(v AS VARCHAR) FROM r""")
def live_readiness(spark, d):
    return LV.readiness(live_panel(spark, d))


def scorer(df):
    z = (F.lit(-1.5) + F.col("event_lag_1d") * 0.5 + F.col("event_mean_7d") * 0.4 + F.col("side_count") * 0.25)
    return df.withColumn("risk_probability", F.round(sigmoid(z), 6))


SCORE = """WITH pr AS (SELECT region, entity, date - make_date(year(date), 10, 1) + 1 AS dos,
    avg(event_count) AS prior FROM obs, liveday WHERE year(date) < year(last) GROUP BY ALL),
  n AS (SELECT f.*, f.date + 1 AS prediction_date, s.side_count FROM livef f
    JOIN side s ON s.region = f.region AND s.entity = f.entity AND s.date = f.date + 1
    WHERE f.date = (SELECT max(date) FROM livef)),
  g AS (SELECT n.* REPLACE (CASE WHEN n.event_mean_7d > 1.2 THEN NULL ELSE n.event_mean_7d END AS event_mean_7d),
    prior FROM n LEFT JOIN pr ON pr.region = n.region AND pr.entity = n.entity
      AND pr.dos = n.prediction_date - make_date(year(n.date), 10, 1) + 1),
  p AS (SELECT prediction_date, region, entity, round(1 / (1 + exp(-(-1.5 + event_lag_1d * 0.5
      + coalesce(event_mean_7d, prior) * 0.4 + side_count * 0.25))), 6) AS risk_probability FROM g
    WHERE coalesce(event_mean_7d, prior) IS NOT NULL)"""


def live_scores(spark, d):
    """Newest day scored; busy entities lose their mean and get the seasonal prior."""
    f = LV.live_features(live_panel(spark, d))
    f = f.withColumn("event_mean_7d", F.when(~(F.col("event_mean_7d") > 1.2), F.col("event_mean_7d")))
    prior = observed(spark, d).filter(F.col("date") < F.lit(live_days(spark, d)[0])).select(
        *DAY_KEYS, F.col("event_count").alias("event_lag_7d"), F.col("event_count").alias("event_mean_7d"))
    rows = LV.scoring_rows(f, prior, side(spark, d).select(*DAY_KEYS, "side_count"))
    return LV.score_live(rows, scorer, 0.5, ["event_lag_1d", "event_mean_7d", "side_count"])


@query("score_live", SCORE + """ SELECT *, CASE WHEN risk_probability >= 0.5 THEN 'Elevated' ELSE 'Normal' END
  AS risk_label FROM p""")
def score_live(spark, d):
    return live_scores(spark, d).select("prediction_date", *KEYS, "risk_probability", "risk_label")


define("preds", """SELECT date AS prediction_date, region, entity,
    CAST((event_count * 37 + CAST(measure_sum AS BIGINT) * 11 + day(date) * 13 + length(entity)) % 1000 AS DOUBLE)
      / 1000::DOUBLE AS risk_probability FROM panel""", "panel")
define("predicted", """SELECT *, CASE WHEN risk_probability >= 0.5 THEN 'Elevated' ELSE 'Normal' END AS risk_label
  FROM preds""", "preds")


def predictions(spark, d):
    p = panel(spark, d)
    mix = (F.col("event_count") * 37 + F.col("measure_sum").cast("bigint") * 11
           + F.dayofmonth("date") * 13 + F.length("entity")) % 1000
    p = p.select(F.col("date").alias("prediction_date"), *KEYS,
                 (mix.cast("double") / F.lit(1000.0)).alias("risk_probability"))
    return p.withColumn("risk_label", risk_label("risk_probability", 0.5))


@query("update_history", SCORE + """ SELECT * FROM predicted WHERE NOT (prediction_date = (SELECT last + 1 FROM liveday) AND
    (region, entity) IN (SELECT (region, entity) FROM p))
  UNION ALL SELECT *, CASE WHEN risk_probability >= 0.5 THEN 'Elevated' ELSE 'Normal' END FROM p""")
def update_history(spark, d):
    new = live_scores(spark, d).select("prediction_date", *KEYS, "risk_probability", "risk_label")
    return LV.update_history(predictions(spark, d), new)


@query("not_predicted", SCORE + """ SELECT region, entity FROM ent WHERE entity NOT IN (SELECT entity FROM p
  WHERE risk_probability >= 0.5)""")
def not_predicted(spark, d):
    return LV.not_predicted(entities(spark, d), live_scores(spark, d).filter("risk_probability >= 0.5"))


VERIFY = """v AS (SELECT p.*, {count} AS actual_count FROM predicted p LEFT JOIN obs o ON o.region = p.region
    AND o.entity = p.entity AND o.date = p.prediction_date),
  w AS (SELECT *, CASE WHEN actual_count > 2 THEN 'Elevated' WHEN actual_count IS NOT NULL THEN 'Normal' END
    AS actual_risk FROM v),
  t AS (SELECT *, CASE WHEN actual_risk IS NULL THEN 'Pending' WHEN actual_risk = risk_label THEN 'Correct'
      ELSE 'Incorrect' END AS verification_status,
    CASE WHEN actual_risk IS NULL THEN 'Pending' WHEN risk_label = 'Elevated' AND actual_risk = 'Elevated'
      THEN 'True Positive' WHEN risk_label = 'Normal' AND actual_risk = 'Normal' THEN 'True Negative'
      WHEN risk_label = 'Elevated' THEN 'False Positive' ELSE 'False Negative' END AS error_type FROM w)"""
SPARSE = VERIFY.format(count="o.event_count")


def tracker(spark, d):
    return H.verify_predictions(predictions(spark, d), observed(spark, d).select(*DAY_KEYS, "event_count"))


@query("verify_predictions", f"WITH {SPARSE} SELECT * FROM t")
def verify_predictions(spark, d):
    """Days without events stay Pending: the counts table has no zero rows."""
    return tracker(spark, d)


@query("verify_with_coverage", f"""WITH {VERIFY.format(count="coalesce(o.event_count, CASE WHEN year(prediction_date) < 2001 THEN 0 END)")}
  SELECT * FROM t""")
def verify_with_coverage(spark, d):
    """With a table of observed days, a missing row there means zero events."""
    seen = panel(spark, d).filter(F.year("date") < 2001).select(*DAY_KEYS)
    return H.verify_predictions(predictions(spark, d), observed(spark, d).select(*DAY_KEYS, "event_count"),
                                observed=seen)


@query("tracker_summary", f"""WITH {SPARSE}, c AS (SELECT count(*) AS total,
    count(*) FILTER (WHERE verification_status = 'Pending') AS pending,
    count(*) FILTER (WHERE verification_status <> 'Pending') AS verified,
    count(*) FILTER (WHERE verification_status = 'Correct') AS correct,
    count(*) FILTER (WHERE verification_status = 'Incorrect') AS incorrect FROM t)
  SELECT *, round(verified / total::DOUBLE, 4) AS verification_coverage,
    round(correct / nullif(verified, 0)::DOUBLE, 4) AS verified_accuracy FROM c""")
def tracker_summary(spark, d):
    return H.tracker_summary(tracker(spark, d))


@query("dashboard_summary", """SELECT max(prediction_date) AS prediction_date, count(*) AS total_entities,
  count(*) FILTER (WHERE risk_label = 'Normal') AS normal_count,
  count(*) FILTER (WHERE risk_label = 'Elevated') AS elevated_count,
  (SELECT entity FROM d ORDER BY risk_probability DESC, entity LIMIT 1) AS highest_risk_entity,
  (SELECT region FROM d ORDER BY risk_probability DESC, entity LIMIT 1) AS highest_risk_region,
  max(risk_probability) AS highest_risk_probability,
  (SELECT risk_label FROM d ORDER BY risk_probability DESC, entity LIMIT 1) AS highest_risk_label
  FROM (SELECT * FROM predicted WHERE prediction_date = (SELECT max(prediction_date) FROM predicted)) d""".replace(
    "FROM d ORDER", "FROM predicted WHERE prediction_date = (SELECT max(prediction_date) FROM predicted) ORDER"))
def dashboard_summary(spark, d):
    from daymosaic.operators.cleaning import latest
    return H.dashboard_summary(latest(predictions(spark, d), "prediction_date"))


THRESHOLD, NAME = 0.4, "next-day"
NUMERIC = ["event_count", "event_lag_1d", "event_lag_3d", "event_lag_7d", "event_mean_3d", "event_mean_7d", "side_value", "side_count"]
COLUMNS = [*NUMERIC, *KEYS]


def training_rows(spark, d):
    """Live features of all seasons before the live one, with the side series and the count of the next day."""
    first = F.lit(live_days(spark, d)[0])
    past = panel(spark, d).select(*DAY_KEYS, "event_count").filter(F.col("date") < first)
    f = L.lead_days(LV.live_features(past), KEYS, ["event_count"], (1,)).filter(F.col("event_count_t_plus_1d").isNotNull())
    later = side(spark, d).select(*KEYS, F.date_sub("date", 1).alias("date"), "side_value", "side_count")
    return materialise(f.join(later, DAY_KEYS, "left").withColumn(
        "y_true", (F.col("event_count_t_plus_1d") > F.col("event_count")).cast("int")), "live-training")


def deploy(spark, d):
    """Fit on the seasons before the live one and store the model; returns the fitted model and its folder."""
    folder, train = run_folder(spark, "models"), training_rows(spark, d)
    fitted = LN.fit(train, NUMERIC, KEYS, LN.logistic("y_true", train.count()), scale=True)
    ST.save_model(fitted, train, folder, NAME, 1, COLUMNS, "y_true", THRESHOLD)
    return fitted, folder


def newest_rows(spark, d):
    """The newest day's features with the side series of the day to predict."""
    prior = observed(spark, d).filter(F.col("date") < F.lit(live_days(spark, d)[0])).select(
        *DAY_KEYS, F.col("event_count").alias("event_lag_7d"), F.col("event_count").cast("double").alias("event_mean_7d"))
    rows = LV.scoring_rows(LV.live_features(live_panel(spark, d)), prior, side(spark, d).select(*DAY_KEYS, "side_value", "side_count"))
    return rows.withColumn("event_lag_7d", F.col("event_lag_7d").cast("bigint"))


TRAINED = """t AS (SELECT p.*, lead(event_count) OVER (PARTITION BY region, entity, year(date) ORDER BY date) AS later FROM panel p, liveday
    WHERE p.date < make_date(year(last), 10, 1)), y AS (SELECT *, later > event_count AS y FROM t WHERE later IS NOT NULL)"""


@query("deploy_model", f"""WITH {TRAINED} SELECT '{NAME}' AS name, 1 AS version, 'y_true' AS target, {THRESHOLD}::DOUBLE AS threshold,
    count(*) AS train_rows, count(*) FILTER (WHERE y) AS train_positives, min(date) AS first_date, max(date) AS last_date,
    '{",".join(COLUMNS)}' AS columns FROM y""")
def deploy_model(spark, d):
    """The record of a model that was fitted, stored and listed."""
    _, folder = deploy(spark, d)
    return ST.records(spark, folder).withColumn("columns", F.concat_ws(",", F.col("columns.name")))


@query("score_stored_model", """SELECT f.date + 1 AS prediction_date, f.region, f.entity, true AS as_in_memory, true AS is_probability,
    true AS label_follows_threshold, true AS wrong_columns_refused FROM livef f WHERE f.date = (SELECT max(date) FROM livef)""")
def score_stored_model(spark, d):
    """A stored model, loaded again, scores the newest day; its scores are compared with those of the model in memory."""
    fitted, folder = deploy(spark, d)
    stored = ST.load_model(spark, folder, NAME, columns=COLUMNS)
    try:
        stored.check(newest_rows(spark, d).drop("event_mean_7d"))
        refused = False
    except ST.ModelMismatch:
        refused = True
    scored = LV.score_live(newest_rows(spark, d), stored.score, stored.record["threshold"], ["event_lag_1d", "side_count"])
    both = fitted.score(scored, "again")
    return both.select("prediction_date", *KEYS, (F.abs(F.col("again") - F.col("risk_probability")) < 1e-12).alias("as_in_memory"),
                       F.col("risk_probability").between(0, 1).alias("is_probability"),
                       ((F.col("risk_probability") >= stored.record["threshold"]) == (F.col("risk_label") == "Elevated")).alias("label_follows_threshold"),
                       F.lit(refused).alias("wrong_columns_refused"))
