"""Splits, preparation, learners, experiments and bootstrap on derived features.

A fitted model's scores are not SQL. Its queries return what SQL can know of them: the rows and positives that were scored, and
checks that hold for any right fit (``judged``). ``logistic_metrics`` shows the metric table as it is.
"""

from __future__ import annotations

from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from daymosaic.functions.features import above
from daymosaic.modelling import bootstrap as BS
from daymosaic.modelling import evaluate as EV
from daymosaic.modelling import learners as LN
from daymosaic.modelling import prepare as PR
from daymosaic.operators import lags as L
from daymosaic.operators import metrics as M
from daymosaic.plans import features as FT
from daymosaic.session import materialise, run_folder
from daymosaic.suite.base import DAY_KEYS, KEYS, define, panel, query, scored, side, table, years

NUMERIC = ["event_count", "measure_sum", "side_value", "side_count", "sin_year", "cos_year",
           "event_lag_1d", "event_lag_2d", "event_lag_3d", "event_lag_7d", "event_mean_3d",
           "event_sparse_mean_7d", "measure_lag_1d", "measure_mean_3d"]
CATEGORICAL = ["region", "entity"]


def splits(spark, d):
    """The last two seasons test, the one before validates, all earlier ones train."""
    ys = years(spark, d)
    return {"train": list(ys[:-3]), "val": list(ys[-3:-2]), "test": list(ys[-2:])}


def ml_rows(spark, d):
    """Calendar features; the label is a next-day sum above the overall mean."""
    f = FT.features_calendar(panel(spark, d).select(*DAY_KEYS, "event_count", "measure_sum"),
                             side(spark, d).select(*DAY_KEYS, "side_value", "side_count"))
    return materialise(f, "ml-rows")


def target(f, h):
    mean = f.agg(F.avg("measure_sum")).scalar()
    return (F.col(f"measure_sum_t_plus_{h}d") > mean).cast("int")


def labelled(spark, d):
    f = ml_rows(spark, d)
    return f.withColumn("y_true", target(f, 1))


def forest(train, y, weight=None):
    return LN.fit(train, NUMERIC, CATEGORICAL, LN.forest(y, weight=weight))


def boosted(train, y, weight=None):
    return LN.fit(train, NUMERIC, CATEGORICAL, LN.boosted(y, weight=weight))


def logistic(train, y):
    return LN.fit(train, NUMERIC, CATEGORICAL, LN.logistic(y, train.count()), scale=True)


def predicted(spark, d, fit_one):
    """The fitted model, its training rows, and the test rows scored under a threshold locked on the validation rows."""
    parts = PR.temporal_split(labelled(spark, d), splits(spark, d))
    model = fit_one(parts["train"], "y_true")
    path = run_folder(spark, "locks")
    EV.lock_threshold(model.score(parts["val"]), path, "model", "score", "y_true")
    t = EV.locked_threshold(spark, path, "model")
    p = model.score(parts["test"]).withColumn("y_pred", (F.col("score") >= t).cast("int")).withColumn("threshold", F.lit(t))
    return model, parts["train"], materialise(p, "predictions")


def judged(p, keys):
    """Checks by key: scores are probabilities, predictions follow a threshold of the grid, and the metrics agree with the counts."""
    step = (F.col("threshold") - 0.01) / (0.98 / 198)
    base = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y_true").alias("positives"),
        F.count_if(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1)).alias("outside"),
        F.every((F.col("score") >= F.col("threshold")) == (F.col("y_pred") == 1)).alias("follows_threshold"),
        F.every(F.abs(step - F.round(step)) < 1e-6).alias("on_grid"))
    m = EV.full_metrics(p, keys, "score", "y_true", "y_pred").select(
        *keys, "tp", "tn", "fp", "fn", "precision", "recall", "f1", "roc_auc", "average_precision")
    j = base.join(m, list(keys))
    counted = (F.col("tp") + F.col("fn") == F.col("positives")) & (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn") == F.col("rows"))
    twice = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    agree = (F.abs(F.col("f1") * twice - 2 * F.col("tp")) < 1e-6) & (F.abs(F.col("recall") * F.col("positives") - F.col("tp")) < 1e-6)
    one_class = (F.col("positives") == 0) | (F.col("positives") == F.col("rows"))
    ranked = F.when(one_class, F.col("roc_auc").isNull()).otherwise(F.col("roc_auc").between(0, 1) & F.col("average_precision").between(0, 1))
    return j.select(*keys, "rows", "positives", "outside", "follows_threshold", "on_grid", (counted & agree).alias("counted"), ranked.alias("ranked"))


def learned(model, train):
    """The log loss on the training rows is below that of their base rate."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("score")))
    loss = -F.avg(F.when(F.col("y_true") == 1, F.ln(p)).otherwise(F.ln(1 - p)))
    rate = F.avg("y_true")
    return model.score(train).agg((loss < -(rate * F.ln(rate) + (1 - rate) * F.ln(1 - rate))).alias("x")).first()[0]


def evaluated(spark, d, fit_one):
    model, train, p = predicted(spark, d, fit_one)
    return judged(p, ["region"]).withColumn("learned", F.lit(learned(model, train)))


JUDGED = "true AS follows_threshold, true AS on_grid, true AS counted, true AS ranked, 0::BIGINT AS outside"
TESTED = f"""SELECT region, count(*) AS rows, sum(y_true)::BIGINT AS positives, {JUDGED}, true AS learned FROM mlrows
  WHERE split = 'test' GROUP BY region"""


define("mlsplit", """SELECT p.region, p.entity, p.date, p.measure_sum, p.event_count, p.event_lag_1d,
    p.event_mean_3d, f.measure_sum AS later FROM full_lags p
  JOIN panel f ON f.region = p.region AND f.entity = p.entity AND f.date = p.date + 1
  JOIN panel g ON g.region = p.region AND g.entity = p.entity AND g.date = p.date + 7""", "full_lags", "panel")
define("mlrows", """SELECT *, (later > (SELECT avg(measure_sum) FROM mlsplit))::INTEGER AS y_true,
  CASE WHEN year(date) < last - 2 THEN 'train' WHEN year(date) = last - 2 THEN 'val' ELSE 'test' END AS split
  FROM mlsplit, (SELECT max(year(l_shipdate)) AS last FROM lineitem) y""", "mlsplit")


@query("temporal_split", "SELECT split, count(*) AS rows, sum(y_true)::BIGINT AS positives FROM mlrows GROUP BY split")
def temporal_split(spark, d):
    return PR.split_counts(PR.temporal_split(labelled(spark, d), splits(spark, d)), "y_true")


@query("one_hot", """SELECT region, entity, count(*) AS n,
  CASE WHEN entity IN ('NATION_0', 'NATION_20') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ones
  FROM mlrows WHERE split = 'test' GROUP BY region, entity""")
def one_hot(spark, d):
    """Vocabulary from training rows; two entities are held out and encode to all zeros."""
    parts = PR.temporal_split(labelled(spark, d), splits(spark, d))
    train = parts["train"].filter(~F.col("entity").isin("NATION_0", "NATION_20"))
    m = PR.encoder([], ["entity"]).fit(train.select("entity"))
    v = m.transform(parts["test"]).withColumn("a", vector_to_array("features"))
    return v.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate(
        "a", F.lit(0.0), lambda x, y: x + y)).alias("ones"))


@query("impute", """WITH t AS (SELECT p_brand, nullif(p_size, 1) AS p_size,
    CASE WHEN p_retailprice < 950 THEN NULL ELSE p_retailprice END AS p_retailprice,
    nullif(p_type, 'SMALL') AS p_type FROM part)
  SELECT 'p_size' AS column, median(p_size)::DOUBLE AS median, NULL::VARCHAR AS mode FROM t
  UNION ALL SELECT 'p_retailprice', median(p_retailprice), NULL FROM t
  UNION ALL SELECT 'p_type', NULL, (SELECT p_type FROM t WHERE p_type IS NOT NULL GROUP BY p_type
    ORDER BY count(*) DESC, p_type LIMIT 1)""")
def impute(spark, d):
    p = table(spark, d, "part").select(
        F.nullif("p_size", F.lit(1)).alias("p_size"),
        F.when(F.col("p_retailprice") >= 950, F.col("p_retailprice")).alias("p_retailprice"),
        F.nullif("p_type", F.lit("SMALL")).alias("p_type"))
    return PR.fill_values(p, ["p_size", "p_retailprice"], ["p_type"])


@query("impute_apply", """WITH t AS (SELECT p_partkey, nullif(p_size, 1) AS p_size, nullif(p_type, 'SMALL') AS p_type FROM part)
  SELECT p_partkey, coalesce(p_size::DOUBLE, (SELECT median(p_size) FROM t)) AS p_size,
    coalesce(p_type, (SELECT p_type FROM t WHERE p_type IS NOT NULL GROUP BY p_type
      ORDER BY count(*) DESC, p_type LIMIT 1)) AS p_type FROM t""")
def impute_apply(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).cast("double").alias("p_size"),
                                       F.nullif("p_type", F.lit("SMALL")).alias("p_type"))
    return PR.fit_imputer(p, ["p_size"], ["p_type"]).transform(p)


@query("scale_features", """WITH s AS (SELECT avg(event_count) AS m, stddev_pop(event_count) AS sd FROM mlrows
    WHERE split = 'train')
  SELECT region, entity, date, round((event_count - m) / sd, 6) AS scaled FROM mlrows, s WHERE split = 'test'""")
def scale_features(spark, d):
    parts = PR.temporal_split(labelled(spark, d), splits(spark, d))
    m = PR.encoder(["event_count"], [], scale=True).fit(parts["train"])
    return m.transform(parts["test"]).select(
        *DAY_KEYS, F.round(vector_to_array("features")[0], 6).alias("scaled"))


@query("logistic_metrics")
def logistic_metrics(spark, d):
    """Metrics by region of the logistic model."""
    return EV.full_metrics(predicted(spark, d, logistic)[2], ["region"], "score", "y_true", "y_pred")


@query("scale_logistic", TESTED.replace("true AS learned", "true AS learned, true AS stationary"))
def scale_logistic(spark, d):
    """The gradient of the penalised log loss is zero at the fitted coefficients."""
    model, train, p = predicted(spark, d, logistic)
    out = judged(p, ["region"]).withColumn("learned", F.lit(learned(model, train)))
    return out.withColumn("stationary", F.lit(LN.gradient(model, train, "y_true") < 1e-3))


@query("random_forest", TESTED)
def random_forest(spark, d):
    return evaluated(spark, d, forest)


@query("boosted_trees", TESTED)
def boosted_trees(spark, d):
    return evaluated(spark, d, boosted)


@query("class_weight_totals", """WITH n AS (SELECT y_true, count(*) AS n FROM mlrows WHERE split = 'train' GROUP BY y_true),
  w AS (SELECT arm, y_true, n, CASE arm WHEN 'none' THEN 1.0 WHEN 'balanced'
      THEN (SELECT sum(n)::DOUBLE / count(*) FROM n) / n.n
      ELSE CASE y_true WHEN 1 THEN factor ELSE 1.0 END END AS weight
    FROM n, (VALUES ('none', 1.0), ('balanced', 1.0), ('weight_1_5', 1.5), ('weight_2', 2.0), ('weight_3', 3.0)) t(arm, factor))
  SELECT arm, y_true, n, weight::DOUBLE AS weight FROM w""")
def class_weight_totals(spark, d):
    train = PR.temporal_split(labelled(spark, d), splits(spark, d))["train"]
    out = None
    for arm in PR.CLASS_WEIGHTS:
        one = PR.class_weight(train, "y_true", PR.CLASS_WEIGHTS[arm]).groupBy("y_true").agg(
            F.count(F.lit(1)).alias("n"), F.max("class_weight").alias("weight")).withColumn("arm", F.lit(arm))
        out = one if out is None else out.unionByName(one)
    return out


@query("class_weight_arms", f"""SELECT arm, 1 AS horizon, count(*) AS rows, sum(y_true)::BIGINT AS positives, {JUDGED} FROM mlrows,
  (VALUES ('none'), ('balanced'), ('weight_1_5'), ('weight_2'), ('weight_3')) a(arm) WHERE split = 'test' GROUP BY arm""")
def class_weight_arms(spark, d):
    """Each weighting through the same split, threshold rule and metrics."""
    f, parts = ml_rows(spark, d), splits(spark, d)

    def arm(spec, train, y):
        return forest(PR.class_weight(train, y, spec), y, "class_weight")
    arms = {a: partial(arm, s) for a, s in PR.CLASS_WEIGHTS.items()}
    p = EV.run_arms(f, arms, [1], lambda h: target(f, h), lambda x: PR.temporal_split(x, parts), DAY_KEYS, run_folder(spark, "locks"))
    return judged(p, ["arm", "horizon"])


def busy():
    """Today is above its recent mean."""
    return F.col("event_count") > F.col("event_mean_3d")


@query("regime_route", TESTED.replace("true AS learned", "true AS learned, count(*) FILTER (WHERE event_count > event_mean_3d) AS continuation_rows"))
def regime_route(spark, d):
    """One model where today is above its recent mean, another where it is not."""
    model, train, p = predicted(spark, d, lambda train, y: LN.fit_routed(train, busy(), lambda t: forest(t, y)))
    routed = p.groupBy("region").agg(F.count_if(busy()).alias("continuation_rows"))
    return judged(p, ["region"]).join(routed, "region").withColumn("learned", F.lit(learned(model, train)))


@query("specialist", f"""SELECT arm, 1 AS horizon, count(*) AS rows, sum(y_true)::BIGINT AS positives, {JUDGED} FROM mlrows,
  (VALUES ('plain'), ('region_balanced')) a(arm) WHERE split = 'test' AND event_count <= event_mean_3d GROUP BY arm""")
def specialist(spark, d):
    """Trained and tested on calm rows only, with and without region balance."""
    f, parts = ml_rows(spark, d), splits(spark, d)
    arms = {"plain": lambda train, y: forest(train, y),
            "region_balanced": lambda train, y: forest(M.balance_weights(train, "region"), y, "weight")}
    y = target(f, 1)
    p = EV.run_arms(f.filter(~busy()), arms, [1], lambda h: y, lambda x: PR.temporal_split(x, parts), DAY_KEYS, run_folder(spark, "locks"))
    return judged(p, ["arm", "horizon"])


@query("persistence", """SELECT region, count(*) AS total, count(*) FILTER (WHERE later > 2 AND now > 2) AS tp,
  count(*) FILTER (WHERE later <= 2 AND now <= 2) AS tn, count(*) FILTER (WHERE later <= 2 AND now > 2) AS fp,
  count(*) FILTER (WHERE later > 2 AND now <= 2) AS fn FROM (SELECT p.region, p.event_count AS now,
    f.event_count AS later FROM panel p JOIN panel f ON f.region = p.region AND f.entity = p.entity
    AND f.date = p.date + 1) GROUP BY region""")
def persistence(spark, d):
    f = L.lead_days(panel(spark, d), KEYS, ["event_count"], (1,)).dropna(subset=["event_count_t_plus_1d"])
    p = LN.persistence(f, "event_count").withColumn("y_true", above("event_count_t_plus_1d", 2))
    return M.class_metrics(M.confusion(p, ["region"])).select("region", "total", *M.CELLS)


@query("climatology", """WITH t AS (SELECT * FROM scored WHERE year(date) < 1999), g AS (SELECT avg(y_true) AS r FROM t),
  e AS (SELECT entity, avg(y_true) AS r FROM t WHERE entity <> 'NATION_3' GROUP BY entity)
  SELECT s.entity, count(*) AS n, (SELECT r FROM g) AS overall, coalesce(max(e.r), (SELECT r FROM g)) AS rate
  FROM scored s LEFT JOIN e ON e.entity = s.entity WHERE year(date) >= 1999 GROUP BY s.entity""")
def climatology(spark, d):
    s = scored(spark, d)
    train, test = s.filter(F.year("date") < 1999), s.filter(F.year("date") >= 1999)
    known = train.withColumn("entity", F.when(F.col("entity") != "NATION_3", F.col("entity")))
    out = LN.climatology(train, test, "y_true", out="overall")
    out = LN.climatology(known, out, "y_true", ["entity"], out="rate")
    return out.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("overall").alias("overall"),
                                     F.max("rate").alias("rate"))


def calibrated_checks(fit_rows, rows, keys):
    """What a logistic map of a score satisfies: it stays a probability, and on the rows that it was fitted on it has
    their rate of positives and no higher log loss than the score."""
    platt = LN.fit_platt(fit_rows, "score", "y_true")
    c = platt.transform(rows, "score")
    p = lambda x: F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(x)))
    loss = lambda x: -F.avg(F.when(F.col("y_true") == 1, F.ln(p(x))).otherwise(F.ln(1 - p(x))))
    at = platt.transform(fit_rows, "score").agg(
        (F.abs(F.avg("calibrated") - F.avg("y_true")) < 1e-4).alias("mean"), (loss("calibrated") <= loss("score") + 1e-9).alias("loss")).first()
    out = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("y_true").cast("bigint").alias("positives"),
                               F.count_if(~F.col("calibrated").between(0, 1)).alias("outside"))
    return out.withColumns({"keeps_rate": F.lit(at["mean"]), "no_worse": F.lit(at["loss"])})


PERIOD = "CASE WHEN year(date) = last - 3 THEN 'check' ELSE 'test' END AS period"
LAST = "(SELECT max(year(l_shipdate)) AS last FROM lineitem) y"
CALIBRATED = "0::BIGINT AS outside, true AS keeps_rate, true AS no_worse"


@query("platt_calibration", f"""SELECT {PERIOD}, count(*) AS rows, sum(y_true)::BIGINT AS positives, {CALIBRATED}
  FROM scored, {LAST} WHERE year(date) >= last - 3 GROUP BY period""")
def platt_calibration(spark, d):
    """Fitted on the seasons up to the fourth last, checked on that, applied to the last three."""
    s, last = scored(spark, d), years(spark, d)[-1]
    y = F.year("date")
    later = s.filter(y >= last - 3).withColumn("period", F.when(y == last - 3, "check").otherwise("test"))
    return calibrated_checks(s.filter(y < last - 3), later, ["period"])


@query("platt_by_horizon", f"""SELECT horizon, {PERIOD.replace("last - 3", "last - 2")}, count(*) AS rows, sum(y)::BIGINT AS positives, {CALIBRATED}
  FROM (SELECT m.date, h.horizon, (f.measure_sum > (SELECT avg(measure_sum) FROM mlsplit))::INTEGER AS y FROM mlsplit m,
    (VALUES (1), (2), (3), (5), (7)) h(horizon) JOIN panel f ON f.region = m.region AND f.entity = m.entity AND f.date = m.date + horizon) r, {LAST}
  WHERE year(date) >= last - 2 GROUP BY horizon, period""")
def platt_by_horizon(spark, d):
    """A model for each horizon; its own scores of one season fit the map, the next season checks it, the last two apply it."""
    f, ys = ml_rows(spark, d), years(spark, d)
    parts = {"train": list(ys[:-4]), "fit": list(ys[-4:-3]), "rest": list(ys[-3:])}
    out = None
    for h in L.DEFAULT_HORIZONS:
        x = PR.temporal_split(f.withColumn("y_true", target(f, h)).filter("y_true is not null"), parts)
        model = logistic(x["train"], "y_true")
        last = F.year("date") == ys[-3]
        rest = model.score(x["rest"]).withColumn("period", F.when(last, "check").otherwise("test"))
        one = calibrated_checks(materialise(model.score(x["fit"]), "fit-scores"), rest, ["period"]).withColumn("horizon", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out


@query("score_checks", """SELECT count(*) AS rows, 0::BIGINT AS missing, 0::BIGINT AS outside FROM mlrows
  WHERE split = 'test'""")
def score_checks(spark, d):
    parts = PR.temporal_split(labelled(spark, d), splits(spark, d))
    return EV.score_checks(logistic(parts["train"], "y_true").score(parts["test"]), "score")


@query("threshold_lock", """WITH g AS (SELECT i, CASE WHEN i = 198 THEN 0.99::DOUBLE ELSE 0.01::DOUBLE
      + i * 0.00494949494949495::DOUBLE END AS threshold FROM range(199) r(i)),
  s AS (SELECT * FROM scored WHERE year(date) = 1999),
  f AS (SELECT threshold, 2.0::DOUBLE * count(*) FILTER (WHERE score >= threshold AND y_true = 1)
    / (count(*) FILTER (WHERE score >= threshold) + count(*) FILTER (WHERE y_true = 1)) AS f1
    FROM g, s GROUP BY threshold)
  SELECT 'valid' AS name, round(threshold, 9) AS threshold FROM f ORDER BY f1 DESC, threshold LIMIT 1""")
def threshold_lock(spark, d):
    path = run_folder(spark, "locks")
    used = EV.lock_threshold(scored(spark, d).filter(F.year("date") == 1999), path, "valid", "score", "y_true")
    t = EV.locked_threshold(spark, path, "valid", expected=used)
    return spark.range(1).select(F.lit("valid").alias("name"), F.round(F.lit(t), 9).alias("threshold"))


@query("feature_importance", f"""SELECT unnest([{", ".join(repr(c) for c in NUMERIC)}]) AS feature, true AS a_share, true AS shares_sum_to_one
  UNION ALL SELECT 'region=' || region, true, true FROM mlrows WHERE split = 'train' GROUP BY region
  UNION ALL SELECT 'entity=' || entity, true, true FROM mlrows WHERE split = 'train' GROUP BY entity""")
def feature_importance(spark, d):
    train = PR.temporal_split(labelled(spark, d), splits(spark, d))["train"]
    f = materialise(LN.feature_importance(forest(train, "y_true"), train), "importance")
    total = f.agg(F.sum("importance")).first()[0]
    return f.select("feature", F.col("importance").between(0, 1).alias("a_share"), F.lit(abs(total - 1) < 1e-9).alias("shares_sum_to_one"))


@query("arms_by_horizon", f"""SELECT arm, horizon, count(*) AS rows, sum((f.measure_sum > (SELECT avg(measure_sum) FROM mlsplit))::INTEGER)::BIGINT
    AS positives, {JUDGED} FROM mlrows m, (VALUES (1), (2), (3), (5), (7)) h(horizon), (VALUES ('base'), ('with_history')) a(arm),
    panel f WHERE f.region = m.region AND f.entity = m.entity AND f.date = m.date + horizon AND split = 'test' GROUP BY arm, horizon""")
def arms_by_horizon(spark, d):
    """Two feature sets over all horizons on one split."""
    f, parts = ml_rows(spark, d), splits(spark, d)

    def arm(cols, train, y):
        return LN.fit(train, cols, CATEGORICAL, LN.forest(y))
    arms = {"base": partial(arm, NUMERIC[:6]), "with_history": partial(arm, NUMERIC)}
    p = EV.run_arms(f, arms, L.DEFAULT_HORIZONS, lambda h: target(f, h), lambda x: PR.temporal_split(x, parts), DAY_KEYS,
                    run_folder(spark, "locks"))
    return judged(p, ["arm", "horizon"])


@query("reproduction_gate", """WITH m AS (SELECT horizon, avg(y_true) AS rate FROM scored GROUP BY horizon)
  SELECT m.horizon, CASE WHEN horizon = 3 THEN 0.5::DOUBLE ELSE rate END AS expected, rate AS actual,
    horizon <> 3 AS passed FROM m""")
def reproduction_gate(spark, d):
    m = scored(spark, d).groupBy("horizon").agg(F.avg("y_true").alias("rate"))
    frozen = m.withColumn("rate", F.when(F.col("horizon") == 3, 0.5).otherwise(F.col("rate")))
    return EV.reproduction_gate(m, frozen, ["horizon"], "rate", 1e-9)


@query("swap_columns", """SELECT p.region, p.entity, p.date, p.event_count, s.side_value + 1 AS side_value
  FROM panel p JOIN side s ON s.region = p.region AND s.entity = p.entity AND s.date = p.date""")
def swap_columns(spark, d):
    a = panel(spark, d).select(*DAY_KEYS, "event_count").join(side(spark, d).select(*DAY_KEYS, "side_value"), DAY_KEYS)
    other = side(spark, d).select(*DAY_KEYS, (F.col("side_value") + 1).alias("side_value"))
    return EV.swap_columns(a, other, DAY_KEYS, ["side_value"])


@query("side_swap_experiment", f"""SELECT variant, count(*) AS rows, sum(y_true)::BIGINT AS positives, {JUDGED}
  FROM mlrows, (VALUES ('original'), ('swapped')) v(variant) WHERE split = 'test' GROUP BY variant""")
def side_swap_experiment(spark, d):
    """The same rows and model with the side series replaced."""
    f, cut = ml_rows(spark, d), 0.5  # the middle of the grid
    doubled = side(spark, d).select(*DAY_KEYS, (F.col("side_value") * 2).alias("side_value"),
                                    (F.col("side_count") + 1).alias("side_count"))
    g = materialise(EV.swap_columns(f, doubled, DAY_KEYS, ["side_value", "side_count"]), "swapped")
    out = None
    for name, data in (("original", f), ("swapped", g)):
        parts = PR.temporal_split(data.withColumn("y_true", target(f, 1)), splits(spark, d))
        model = logistic(parts["train"], "y_true")
        p = model.score(parts["test"]).select(F.lit(name).alias("variant"), "y_true", "score", F.lit(cut).alias("threshold"),
                                              (F.col("score") >= cut).cast("int").alias("y_pred"))
        p = materialise(p, "swap")
        out = p if out is None else out.unionByName(p)
    return judged(out, ["variant"])


REPS, SEED = 10_000, 11
BOOT_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
#: Prediction and score of the models compared: two scored ones and today's count, which takes six values.
MODELS = {"a": ("y_pred", "score"), "b": ("y_pred_b", "score_b"), "today": ("persistence", "score_today")}
COMPARISONS = [("a", "b"), ("today", "a"), ("today", "b")]


def bootstrap(spark, d):
    s = scored(spark, d).withColumn("score_today", F.col("count_now").cast("double") / F.lit(5.0))
    return BS.paired_bootstrap(s, "region", BOOT_KEY, MODELS, COMPARISONS, REPS, SEED)


@query("bootstrap_intervals")
def bootstrap_intervals(spark, d):
    """All 10,000 replicates over all scored rows, by region and pooled."""
    return bootstrap(spark, d)


def boot_point(m: str, pred: str, score: str) -> str:
    return f"""SELECT region, '{m}' AS model, 'f1' AS metric, 2.0::DOUBLE * sum(y_true * {pred}) / (sum(y_true) + sum({pred})) AS v
      FROM r GROUP BY region
    UNION ALL SELECT region, '{m}', 'average_precision', sum(pos * cp::DOUBLE / cn) / max(tp) FROM (
      SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY region) AS tp FROM (
        SELECT region, {score} AS score, sum(y_true) AS pos, count(*) AS n FROM r GROUP BY ALL)
      WINDOW w AS (PARTITION BY region ORDER BY score DESC)) WHERE pos > 0 GROUP BY region"""


@query("paired_bootstrap", f"""WITH s AS (SELECT *, count_now / 5.0::DOUBLE AS score_today FROM scored),
  r AS (SELECT * FROM s UNION ALL SELECT * REPLACE ('POOLED' AS region) FROM s),
  p AS ({' UNION ALL '.join(boot_point(m, *c) for m, c in MODELS.items())}),
  n AS (SELECT region, count(*) AS rows, sum(y_true)::BIGINT AS positives FROM r GROUP BY region)
  SELECT a.region, a.model AS reference, b.model AS candidate, a.metric, round(a.v, 9) AS reference_point, round(b.v, 9) AS candidate_point,
    round(b.v - a.v, 9) AS difference, {REPS}::BIGINT AS valid_replicates, rows, positives, true AS holds_difference, true AS narrow
  FROM p a JOIN p b ON a.region = b.region AND a.metric = b.metric JOIN n ON n.region = a.region
    JOIN (VALUES {', '.join(str(c) for c in COMPARISONS)}) c(x, y) ON c.x = a.model AND c.y = b.model""")
def paired_bootstrap(spark, d):
    """The same run without its drawn bounds, which are checked instead: each interval holds its point estimate and is narrow."""
    out = bootstrap(spark, d)
    width = F.col("ci_upper") - F.col("ci_lower")
    out = out.withColumn("holds_difference", F.col("difference").between(F.col("ci_lower"), F.col("ci_upper")))
    # three times the widest that a binomial share over as many positives could be
    out = out.withColumn("narrow", (width > 0) & (width < 12 / F.sqrt("positives")))
    out = out.withColumns({c: F.round(c, 9) for c in ("reference_point", "candidate_point", "difference")})
    return out.drop("ci_lower", "ci_upper")
