"""Classification, ranking, calibration and threshold queries on scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymosaic.functions import text
from daymosaic.functions.calendar import horizon_label
from daymosaic.operators import joins as J
from daymosaic.operators import metrics as M
from daymosaic.suite.base import KEYS, query, scored

CONF = """count(*) FILTER (WHERE y_true = 1 AND {p} = 1) AS tp,
  count(*) FILTER (WHERE y_true = 0 AND {p} = 0) AS tn,
  count(*) FILTER (WHERE y_true = 0 AND {p} = 1) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND {p} = 0) AS fn"""
C = CONF.format(p="y_pred")
RATIOS = """tp + tn + fp + fn AS total, tp + fn AS positives, tp + fp AS predicted_positives,
  coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0) AS accuracy,
  (coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2
    AS balanced_accuracy,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  coalesce((tp + fn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0) AS prevalence,
  fp::DOUBLE / nullif(fp + tn, 0) AS fp_rate, fn::DOUBLE / nullif(fn + tp, 0) AS fn_rate"""


@query("confusion", f"SELECT horizon, {C} FROM scored GROUP BY horizon")
def confusion(spark, d):
    return M.confusion(scored(spark, d), ["horizon"])


@query("class_metrics", f"""WITH c AS (SELECT horizon, region, {C} FROM scored GROUP BY ALL)
  SELECT *, {RATIOS} FROM c""")
def class_metrics(spark, d):
    return M.class_metrics(M.confusion(scored(spark, d), ["horizon", "region"]))


PHASE_SQL = """CASE WHEN month(date) = 10 AND day(date) >= 15 THEN 'Early season'
  WHEN month(date) = 11 AND day(date) <= 15 THEN 'Middle season'
  WHEN month(date) = 11 AND day(date) <= 23 THEN 'Late season' ELSE 'Other' END"""
DIMS = ["horizon", "region", "entity", "phase", "regime"]
SETS = [["horizon"], ["horizon", "region", "entity"], ["horizon", "region"], ["horizon", "phase"],
        ["horizon", "regime"], ["horizon", "region", "regime"], ["horizon", "region", "phase"]]
NAMES = ("CASE " + " ".join(
    "WHEN grouping(horizon, region, entity, phase, regime) = "
    f"{sum((d not in s) << (4 - i) for i, d in enumerate(DIMS))} THEN '{'|'.join(s)}'"
    for s in SETS) + " END")


@query("grouped_metrics", f"""WITH s AS (SELECT *, {PHASE_SQL} AS phase FROM scored),
  c AS (SELECT horizon, region, entity, phase, regime, {C}, {NAMES} AS analysis,
    concat_ws(' | ', CAST(horizon AS VARCHAR), region, entity, phase, regime) AS "group"
    FROM s GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in SETS)}))
  SELECT *, {RATIOS} FROM c""")
def grouped_metrics(spark, d):
    s = scored(spark, d).withColumn(
        "phase", J.phase_column("date", J.PHASES_BOUNDED, "Other"))
    return M.grouped_metrics(s, DIMS, SETS)


@query("multi_analysis", f"""WITH a AS (SELECT horizon, region, {C} FROM scored
    GROUP BY GROUPING SETS ((), (horizon), (region), (horizon, region))),
  b AS (SELECT horizon, region, {CONF.format(p='y_pred_b')} FROM scored
    GROUP BY GROUPING SETS ((), (horizon), (region), (horizon, region)))
  SELECT a.horizon, a.region,
    coalesce((2 * a.tp)::DOUBLE / nullif(2 * a.tp + a.fp + a.fn, 0), 0) AS f1_a,
    coalesce((2 * b.tp)::DOUBLE / nullif(2 * b.tp + b.fp + b.fn, 0), 0) AS f1_b,
    coalesce((2 * b.tp)::DOUBLE / nullif(2 * b.tp + b.fp + b.fn, 0), 0)
      - coalesce((2 * a.tp)::DOUBLE / nullif(2 * a.tp + a.fp + a.fn, 0), 0) AS f1_delta
  FROM a JOIN b ON a.horizon IS NOT DISTINCT FROM b.horizon
    AND a.region IS NOT DISTINCT FROM b.region""")
def multi_analysis(spark, d):
    y, a, b = F.col("y_true"), F.col("y_pred"), F.col("y_pred_b")
    counts = {}
    for n, p in (("a", a), ("b", b)):
        counts |= {f"tp_{n}": F.count_if((y == 1) & (p == 1)),
                   f"fp_{n}": F.count_if((y == 0) & (p == 1)),
                   f"fn_{n}": F.count_if((y == 1) & (p == 0))}
    out = M.grouped_counts(scored(spark, d), ["horizon", "region"],
                           [[], ["horizon"], ["region"], ["horizon", "region"]], counts)
    f1 = {n: M.ratio_or_zero(2 * F.col(f"tp_{n}"), 2 * F.col(f"tp_{n}") + F.col(f"fp_{n}")
                             + F.col(f"fn_{n}")) for n in "ab"}
    return out.select("horizon", "region", f1["a"].alias("f1_a"), f1["b"].alias("f1_b"),
                      (f1["b"] - f1["a"]).alias("f1_delta"))


@query("agreement", """WITH c AS (SELECT horizon, region,
    count(*) FILTER (WHERE y_pred = y_true AND persistence = y_true) AS both_correct,
    count(*) FILTER (WHERE y_pred = y_true AND persistence <> y_true) AS model_only,
    count(*) FILTER (WHERE y_pred <> y_true AND persistence = y_true) AS baseline_only,
    count(*) FILTER (WHERE y_pred <> y_true AND persistence <> y_true) AS both_wrong,
    grouping(horizon, region) AS level, count(*) AS total
    FROM scored GROUP BY ROLLUP (horizon, region))
  SELECT *, both_correct / total::DOUBLE AS both_correct_share,
    model_only / total::DOUBLE AS model_only_share,
    baseline_only / total::DOUBLE AS baseline_only_share,
    both_wrong / total::DOUBLE AS both_wrong_share FROM c""")
def agreement(spark, d):
    return M.agreement(scored(spark, d), ["horizon", "region"], "y_true", "y_pred", "persistence")


@query("transition_table", """SELECT horizon, transition, total, model_correct, baseline_correct,
  model_only, baseline_only, model_correct / total::DOUBLE AS model_accuracy,
  baseline_correct / total::DOUBLE AS baseline_accuracy FROM (SELECT horizon, transition,
    count(*) AS total, count(*) FILTER (WHERE y_pred = y_true) AS model_correct,
    count(*) FILTER (WHERE persistence = y_true) AS baseline_correct,
    count(*) FILTER (WHERE y_pred = y_true AND persistence <> y_true) AS model_only,
    count(*) FILTER (WHERE y_pred <> y_true AND persistence = y_true) AS baseline_only
    FROM scored GROUP BY ALL)""")
def transition_table(spark, d):
    return M.transition_table(scored(spark, d), ["horizon", "transition"], "y_true", "y_pred",
                              "persistence")


RECALL = """SELECT horizon, region, events, model_caught, model_missed, baseline_caught,
  model_caught / events::DOUBLE AS model_recall, baseline_caught / events::DOUBLE AS baseline_recall
  FROM (SELECT horizon, region, count(*) AS events,
    count(*) FILTER (WHERE y_pred = 1) AS model_caught,
    count(*) FILTER (WHERE y_pred = 0) AS model_missed,
    count(*) FILTER (WHERE persistence = 1) AS baseline_caught
    FROM scored WHERE transition = '{t}' GROUP BY ALL)"""


@query("onset_recall", RECALL.format(t="N->E"))
def onset_recall(spark, d):
    return M.transition_recall(scored(spark, d), ["horizon", "region"], "N->E", "y_pred",
                               "persistence")


@query("continuation_recall", RECALL.format(t="E->E"))
def continuation_recall(spark, d):
    return M.transition_recall(scored(spark, d), ["horizon", "region"], "E->E", "y_pred",
                               "persistence")


@query("reliability_bins", """SELECT horizon, bin, count(*) AS n, round(avg(score), 9) AS mean_score,
  round(avg(y_true), 9) AS actual_rate, round(avg(score) - avg(y_true), 9) AS gap,
  bin / 10.0::DOUBLE AS bin_low, (bin + 1) / 10.0::DOUBLE AS bin_high
  FROM (SELECT *, (SELECT max(k) FROM range(10) t(k)
    WHERE k = 0 OR score > k / 10.0::DOUBLE)::INTEGER AS bin FROM scored) GROUP BY horizon, bin""")
def reliability_bins(spark, d):
    out = M.reliability_bins(scored(spark, d), ["horizon"], "score", "y_true")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_score", "actual_rate", "gap")})


@query("ece", """WITH b AS (SELECT horizon, (SELECT max(k) FROM range(10) t(k)
      WHERE score >= k / 10.0::DOUBLE) AS bin, score, y_true FROM scored),
  g AS (SELECT horizon, bin, count(*) AS n, abs(avg(score) - avg(y_true)) AS gap FROM b GROUP BY ALL)
  SELECT horizon, round(sum(n * gap) / sum(n), 9) AS ece FROM g GROUP BY horizon""")
def ece(spark, d):
    return M.ece(scored(spark, d), ["horizon"], "score", "y_true").withColumn(
        "ece", F.round("ece", 9))


@query("prob_scores", """SELECT horizon, region, round(avg((score - y_true) * (score - y_true)), 9)
    AS brier, round(-avg(CASE WHEN y_true = 1 THEN ln(greatest(least(score, 0.9999999), 1e-7))
      ELSE ln(1 - greatest(least(score, 0.9999999), 1e-7)) END), 9) AS log_loss,
  round(avg(score), 9) AS mean_score, round(avg(y_true), 9) AS actual_rate,
  round(avg(score) - avg(y_true), 9) AS score_minus_rate FROM scored GROUP BY horizon, region""")
def prob_scores(spark, d):
    out = M.prob_scores(scored(spark, d), ["horizon", "region"], "score", "y_true")
    return out.select("horizon", "region", *[F.round(c, 9).alias(c) for c in (
        "brier", "log_loss", "mean_score", "actual_rate", "score_minus_rate")])


@query("mae", """SELECT p.region, avg(abs(f.event_count - p.event_count)) AS mae FROM panel p
  JOIN panel f ON f.region = p.region AND f.entity = p.entity AND f.date = p.date + 1
  GROUP BY p.region""")
def mae(spark, d):
    from daymosaic.operators import lags as L
    from daymosaic.suite.base import panel
    f = L.lead_days(panel(spark, d), KEYS, ["event_count"], (1,))
    return M.mae(f, ["region"], "event_count_t_plus_1d", "event_count")


FRAME = """g AS (SELECT horizon, region, score, sum({w} * y_true) AS pos,
    sum({w} * (1 - y_true)) AS neg FROM scored GROUP BY ALL),
  f AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
    sum(pos) OVER (PARTITION BY horizon, region) AS total_pos,
    sum(neg) OVER (PARTITION BY horizon, region) AS total_neg FROM g
    WINDOW w AS (PARTITION BY horizon, region ORDER BY score DESC))"""
PLAIN = FRAME.format(w="1")


@query("roc_auc", f"""WITH {PLAIN} SELECT horizon, region, round(sum(neg * (2 * cum_pos - pos) / 2.0::DOUBLE)
  / nullif(max(total_pos)::DOUBLE * max(total_neg), 0), 9) AS roc_auc FROM f GROUP BY horizon, region""")
def roc_auc(spark, d):
    return M.rank_metrics(scored(spark, d), ["horizon", "region"], "score", "y_true").select(
        "horizon", "region", F.round("roc_auc", 9).alias("roc_auc"))


@query("average_precision", f"""WITH {PLAIN} SELECT horizon, region,
  round(sum(pos * cum_pos::DOUBLE / (cum_pos + cum_neg)) / max(total_pos), 9) AS average_precision
  FROM f GROUP BY horizon, region""")
def average_precision(spark, d):
    return M.rank_metrics(scored(spark, d), ["horizon", "region"], "score", "y_true").select(
        "horizon", "region", F.round("average_precision", 9).alias("average_precision"))


@query("roc_curve", f"""WITH {PLAIN} SELECT horizon, region, score AS threshold,
  cum_neg::DOUBLE / nullif(total_neg, 0) AS fpr, cum_pos::DOUBLE / nullif(total_pos, 0) AS tpr FROM f""")
def roc_curve(spark, d):
    return M.roc_curve(scored(spark, d), ["horizon", "region"], "score", "y_true")


@query("pr_curve", f"""WITH {PLAIN} SELECT horizon, region, score AS threshold,
  cum_pos::DOUBLE / (cum_pos + cum_neg) AS precision,
  cum_pos::DOUBLE / nullif(total_pos, 0) AS recall FROM f""")
def pr_curve(spark, d):
    return M.pr_curve(scored(spark, d), ["horizon", "region"], "score", "y_true")


def grid_sql(low: float, high: float, n: int) -> str:
    step = repr((high - low) / (n - 1))
    return (f"(SELECT CASE WHEN i = {n - 1} THEN {high}::DOUBLE ELSE {low}::DOUBLE "
            f"+ i * {step}::DOUBLE END AS threshold FROM range({n}) r(i))")


SWEEP = """s AS (SELECT horizon, score, count(*) FILTER (WHERE y_true = 1) AS pos,
    count(*) FILTER (WHERE y_true = 0) AS neg FROM scored GROUP BY ALL),
  h AS (SELECT horizon, sum(pos)::BIGINT AS total_pos, sum(neg)::BIGINT AS total_neg
    FROM s GROUP BY horizon),
  c AS (SELECT h.horizon, t.threshold, h.total_pos, h.total_neg,
    coalesce(sum(pos) FILTER (WHERE s.score >= t.threshold), 0)::BIGINT AS tp,
    coalesce(sum(neg) FILTER (WHERE s.score >= t.threshold), 0)::BIGINT AS fp
    FROM h CROSS JOIN {grid} t JOIN s ON s.horizon = h.horizon
    GROUP BY ALL)"""


@query("threshold_sweep", f"""WITH {SWEEP.format(grid=grid_sql(0.05, 0.95, 181))} SELECT horizon,
  threshold, tp, fp, total_pos - tp AS fn, total_neg - fp AS tn,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(total_pos, 0), 0) AS recall,
  coalesce((2 * tp)::DOUBLE / nullif(tp + fp + total_pos, 0), 0) AS f1,
  (tp + total_neg - fp)::DOUBLE / (total_pos + total_neg) AS accuracy,
  (tp + fp)::DOUBLE / (total_pos + total_neg) AS predicted_positive_rate FROM c""")
def threshold_sweep(spark, d):
    return M.threshold_sweep(scored(spark, d), ["horizon"], "score", "y_true")


def pick_sql(candidates: str) -> str:
    """Candidates are (horizon, threshold); scores are those of the same horizon."""
    return f"""WITH s AS (SELECT horizon, score, count(*) FILTER (WHERE y_true = 1) AS pos,
      count(*) FILTER (WHERE y_true = 0) AS neg FROM scored GROUP BY ALL),
    t AS ({candidates}),
    c AS (SELECT t.horizon, t.threshold, sum(pos)::BIGINT AS total_pos,
      coalesce(sum(pos) FILTER (WHERE s.score >= t.threshold), 0)::BIGINT AS tp,
      coalesce(sum(neg) FILTER (WHERE s.score >= t.threshold), 0)::BIGINT AS fp
      FROM t JOIN s ON s.horizon = t.horizon GROUP BY ALL),
    f AS (SELECT horizon, threshold, coalesce((2 * tp)::DOUBLE / nullif(tp + fp + total_pos, 0), 0) AS f1 FROM c)
    SELECT horizon, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY horizon
      ORDER BY f1 DESC, threshold) AS rn FROM f) WHERE rn = 1"""


EACH = "SELECT DISTINCT s.horizon, g.threshold FROM s CROSS JOIN {g} g"
SCORES = "SELECT DISTINCT horizon, score AS threshold FROM s"


@query("pick_threshold_grid", pick_sql(EACH.format(g=grid_sql(0.01, 0.99, 199))))
def pick_threshold_grid(spark, d):
    return M.pick_threshold(scored(spark, d), ["horizon"], "score", "y_true", "grid")


@query("pick_threshold_grid_and_scores", pick_sql(
    f"{EACH.format(g=grid_sql(0.01, 0.99, 197))} UNION {SCORES} UNION SELECT DISTINCT horizon, 0.5::DOUBLE FROM s"))
def pick_threshold_grid_and_scores(spark, d):
    return M.pick_threshold(scored(spark, d), ["horizon"], "score", "y_true", "grid_and_scores")


@query("pick_threshold_scores", pick_sql(
    f"{SCORES} UNION SELECT DISTINCT horizon, 0.0::DOUBLE FROM s UNION SELECT DISTINCT horizon, 1.0::DOUBLE FROM s"))
def pick_threshold_scores(spark, d):
    return M.pick_threshold(scored(spark, d), ["horizon"], "score", "y_true", "scores")


@query("balance_weights", """WITH n AS (SELECT region, count(*) AS n FROM scored GROUP BY region),
  w AS (SELECT s.region, (SELECT sum(n)::DOUBLE / count(*) FROM n) / n.n AS weight
    FROM scored s JOIN n ON s.region = n.region)
  SELECT region, count(*) AS rows, min(weight) AS weight, round(sum(weight), 4) AS total_weight
  FROM w GROUP BY region""")
def balance_weights(spark, d):
    return M.balance_weights(scored(spark, d), "region").groupBy("region").agg(
        F.count(F.lit(1)).alias("rows"), F.min("weight").alias("weight"),
        F.round(F.sum("weight"), 4).alias("total_weight"))


@query("weighted_metrics", f"""WITH {FRAME.format(w='(1 + l_partkey % 4)')},
  a AS (SELECT horizon, region, round(sum(pos * cum_pos::DOUBLE / (cum_pos + cum_neg))
    / max(total_pos), 9) AS average_precision FROM f GROUP BY horizon, region),
  c AS (SELECT horizon, region,
    sum((1 + l_partkey % 4) * y_true * y_pred) AS tp,
    sum((1 + l_partkey % 4) * (1 - y_true) * y_pred) AS fp,
    sum((1 + l_partkey % 4) * y_true * (1 - y_pred)) AS fn FROM scored GROUP BY ALL)
  SELECT a.horizon, a.region, average_precision,
    coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1
  FROM a JOIN c ON a.horizon = c.horizon AND a.region = c.region""")
def weighted_metrics(spark, d):
    s = scored(spark, d).withColumn("w", 1 + F.col("l_partkey") % 4)
    return M.weighted_metrics(s, ["horizon", "region"], "y_true", "y_pred", "score", "w").select(
        "horizon", "region", F.round("average_precision", 9).alias("average_precision"), "f1")


@query("case_labels", """SELECT transition, regime,
  CASE WHEN y_true = 1 AND y_pred = 1 THEN 'TP' WHEN y_true = 0 AND y_pred = 0 THEN 'TN'
    WHEN y_true = 0 THEN 'FP' ELSE 'FN' END AS error_type,
  CASE WHEN score >= 0.5 THEN 'Elevated' ELSE 'Normal' END AS risk_label,
  CASE WHEN score >= 0.60 THEN 'Very high' WHEN score >= 0.40 THEN 'High'
    WHEN score >= 0.20 THEN 'Moderate' ELSE 'Low' END AS risk_band,
  '+' || horizon || 'd' AS horizon, count(*) AS n FROM scored GROUP BY ALL""")
def case_labels(spark, d):
    s = scored(spark, d).select(
        "transition", "regime", text.confusion_cell("y_true", "y_pred").alias("error_type"),
        text.risk_label("score", 0.5).alias("risk_label"),
        text.risk_band("score").alias("risk_band"),
        horizon_label(F.col("horizon")).alias("horizon"))
    return s.groupBy(*s.columns).agg(F.count(F.lit(1)).alias("n"))
