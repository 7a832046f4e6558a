"""Event aggregation, profiles, distributions, summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daymosaic.operators import aggregates as A
from daymosaic.operators import lags as L
from daymosaic.operators import panel as P
from daymosaic.operators import sketches as SK
from daymosaic.session import materialise
from daymosaic.suite.base import (DAY_KEYS, KEYS, YEARS, years, define, entities, events, observed,
                                  panel, query, scored)

D = "::DOUBLE"


@query("daily_count", "SELECT region, entity, date, count(*) AS event_count FROM ev GROUP BY ALL")
def daily_count(spark, d):
    return P.daily_count(events(spark, d), DAY_KEYS)


@query("event_metrics", "SELECT * FROM obs")
def event_metrics(spark, d):
    return observed(spark, d)


# a cell is one supplier's site inside its entity
define("celldays", """SELECT region, entity, l_suppkey AS cell, date, count(*) AS event_count,
  sum(measure) AS measure_sum FROM ev GROUP BY ALL""", "ev")


def cell_days(spark, d):
    return events(spark, d).groupBy(*KEYS, F.col("l_suppkey").alias("cell"), "date").agg(
        F.count(F.lit(1)).alias("event_count"), F.sum("measure").alias("measure_sum"))


@query("cell_rollup", """SELECT region, entity, date,
  count(*) FILTER (WHERE event_count > 0) AS active_cell_count,
  max(event_count) AS max_cell_event_count, max(measure_sum) AS max_cell_measure,
  sum(event_count)::BIGINT AS cell_event_count_sum,
  CASE WHEN sum(event_count) > 0 THEN max(event_count) / sum(event_count)::DOUBLE ELSE 0 END
    AS max_cell_share FROM celldays GROUP BY region, entity, date""")
def cell_rollup(spark, d):
    return P.cell_rollup(cell_days(spark, d), DAY_KEYS)


@query("distinct_count", """SELECT region, count(DISTINCT entity) AS entities FROM ent GROUP BY region""")
def distinct_count(spark, d):
    return A.distinct_count(entities(spark, d), ["region"], "entity", "entities")


@query("entities_in_many_regions", """SELECT l_partkey, count(DISTINCT region) AS n FROM ev
  GROUP BY l_partkey HAVING count(DISTINCT region) > 1""")
def entities_in_many_regions(spark, d):
    return A.having_more_than(events(spark, d), ["l_partkey"], "region")


@query("coverage_gaps", """SELECT region, entity, year, count(*) AS rows, min(date) AS first_date,
  max(date) AS last_date, max(date) - min(date) + 1 AS calendar_days,
  max(date) - min(date) + 1 - count(*) AS missing_days
  FROM (SELECT *, year(date) AS year FROM obs) GROUP BY region, entity, year""")
def coverage_gaps(spark, d):
    return A.coverage_gaps(observed(spark, d), KEYS)


@query("equal_coverage", """SELECT year, count(*) AS entities, count(DISTINCT rows) AS distinct_counts,
  min(rows) AS min_rows, max(rows) AS max_rows FROM (SELECT region, entity, year(date) AS year,
  count(*) AS rows FROM obs GROUP BY ALL) GROUP BY year""")
def equal_coverage(spark, d):
    return A.equal_coverage(observed(spark, d), KEYS)


@query("value_counts", """SELECT confidence, daynight, count(*) AS n,
  count(*) / (SELECT count(*) FROM ev)::DOUBLE AS share FROM ev GROUP BY ALL""")
def value_counts(spark, d):
    return A.value_counts(events(spark, d), ["confidence", "daynight"])


@query("describe", """SELECT region, count(measure) AS count, avg(measure) AS mean,
  round(stddev_samp(measure), 6) AS std, min(measure) AS min, max(measure) AS max,
  quantile_cont(measure, 0.25) AS p25, quantile_cont(measure, 0.5) AS p50,
  quantile_cont(measure, 0.75) AS p75 FROM ev GROUP BY region""")
def describe(spark, d):
    return A.describe(events(spark, d), ["region"], "measure").withColumn("std", F.round("std", 6))


CUTS = [(0, 2), (1, 3), (2, 5), (0, 1)]
CUT_SQL = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in CUTS)


@query("class_balance", f"""SELECT region, n, low_cut, high_cut, low, medium, high,
  low / n::DOUBLE AS low_share, medium / n::DOUBLE AS medium_share, high / n::DOUBLE AS high_share
  FROM (SELECT region, a AS low_cut, b AS high_cut, count(*) AS n,
    count(*) FILTER (WHERE event_count <= a) AS low,
    count(*) FILTER (WHERE event_count > a AND event_count <= b) AS medium,
    count(*) FILTER (WHERE event_count > b) AS high
    FROM panel, (VALUES {CUT_SQL}) c(a, b) GROUP BY ALL)""")
def class_balance(spark, d):
    return A.class_balance(panel(spark, d), ["region"], "event_count", CUTS)


THRESHOLDS = [0, 1, 2, 3, 5, 10]


@query("share_above", f"""SELECT year, threshold, n, above, above / n::DOUBLE AS share FROM (
  SELECT year(date) AS year, t AS threshold, count(*) AS n,
    count(*) FILTER (WHERE event_count > t) AS above
  FROM panel, (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) c(t) GROUP BY ALL)""")
def share_above(spark, d):
    p = panel(spark, d).withColumn("year", F.year("date"))
    return A.share_above(p, ["year"], "event_count", THRESHOLDS)


@query("quantile_balance", """WITH q AS (SELECT region, quantile_cont(measure_sum, 0.25) AS low_cut,
    quantile_cont(measure_sum, 0.75) AS high_cut, 0.25::DOUBLE AS low_quantile,
    0.75::DOUBLE AS high_quantile FROM obs GROUP BY region UNION ALL
    SELECT region, quantile_cont(measure_sum, 0.5), quantile_cont(measure_sum, 0.9),
    0.5::DOUBLE, 0.9::DOUBLE FROM obs GROUP BY region),
  s AS (SELECT q.*, count(*) AS n, count(*) FILTER (WHERE measure_sum <= low_cut) AS low,
    count(*) FILTER (WHERE measure_sum > low_cut AND measure_sum <= high_cut) AS medium,
    count(*) FILTER (WHERE measure_sum > high_cut) AS high
    FROM q JOIN obs ON q.region = obs.region GROUP BY ALL)
  SELECT *, low / n::DOUBLE AS low_share, medium / n::DOUBLE AS medium_share,
    high / n::DOUBLE AS high_share FROM s""")
def quantile_balance(spark, d):
    return A.quantile_balance(observed(spark, d), ["region"], "measure_sum",
                              [(0.25, 0.75), (0.5, 0.9)])


TARGETS = " UNION ALL ".join(f"""SELECT {h} AS horizon, f.event_count AS value FROM panel p
  JOIN panel f ON f.region = p.region AND f.entity = p.entity AND f.date = p.date + {h}"""
                             for h in L.DEFAULT_HORIZONS)


@query("target_distribution", f"""WITH t AS ({TARGETS}), b AS (SELECT horizon, count(*) AS rows,
    avg(value) AS mean, quantile_cont(value, 0.5) AS median,
    count(*) FILTER (WHERE value = 0) / count(*)::DOUBLE AS zero_share,
    count(*) FILTER (WHERE value > 2) / count(*)::DOUBLE AS label_share FROM t GROUP BY horizon)
  SELECT *, label_share / nullif((SELECT label_share FROM b WHERE horizon = 1), 0)
    AS relative_to_first FROM b""")
def target_distribution(spark, d):
    f = L.lead_days(panel(spark, d), KEYS, ["event_count"])
    return A.target_distribution(f, "event_count", L.DEFAULT_HORIZONS)


@query("pivot_region_year", "SELECT region, " + ", ".join(
    f'sum(CASE WHEN year(date) = {y} THEN 1 END)::BIGINT AS "{y}"' for y in YEARS)
    + " FROM ev GROUP BY region")
def pivot_region_year(spark, d):
    e = events(spark, d).withColumn("year", F.year("date"))
    return A.pivot_counts(e, ["region"], "year", YEARS, F.count(F.lit(1)))


@query("crosstab_transition", """SELECT transition,
  count(*) FILTER (WHERE regime = 'No current activity') AS none,
  count(*) FILTER (WHERE regime = 'Low current activity') AS low,
  count(*) FILTER (WHERE regime = 'Elevated current activity') AS elevated
  FROM scored GROUP BY transition""")
def crosstab_transition(spark, d):
    from daymosaic.functions.text import REGIMES
    wide = A.pivot_counts(scored(spark, d), ["transition"], "regime", REGIMES, F.count(F.lit(1)))
    return wide.select("transition", *[F.coalesce(F.col(r), F.lit(0)).alias(n)
                                       for r, n in zip(REGIMES, ("none", "low", "elevated"))])


@query("split_summary", """SELECT split, region, count(*) AS rows, sum(y_true)::BIGINT AS positives,
  grouping(split, region) AS level, sum(y_true) / count(*)::DOUBLE AS prevalence
  FROM (SELECT *, CASE WHEN year(date) <= 1998 THEN 'train' WHEN year(date) = 1999 THEN 'val'
    ELSE 'test' END AS split FROM scored) GROUP BY ROLLUP (split, region)""")
def split_summary(spark, d):
    y = F.year("date")
    s = scored(spark, d).withColumn("split", F.when(y <= 1998, "train").when(y == 1999, "val")
                                    .otherwise("test"))
    return A.split_summary(s, "split", "region", "y_true")


@query("null_profile", """WITH j AS (SELECT k.*, o.event_count, o.measure_sum, o.measure_mean
    FROM skel k LEFT JOIN obs o ON k.region = o.region AND k.entity = o.entity AND k.date = o.date)
  SELECT c AS column, count(*) AS rows,
    count(*) FILTER (WHERE event_count IS NOT NULL) AS complete_rows,
    count(*) FILTER (WHERE event_count IS NULL) AS nulls
  FROM j, (VALUES ('event_count'), ('measure_sum'), ('measure_mean')) t(c) GROUP BY c""")
def null_profile(spark, d):
    from daymosaic.functions.calendar import season_dates
    skel = P.skeleton(entities(spark, d), KEYS, season_dates(years(spark, d)))
    j = skel.join(observed(spark, d), DAY_KEYS, "left")
    return A.null_profile(j, ["event_count", "measure_sum", "measure_mean"])


EXT = " UNION ALL ".join(f"""SELECT '{c}' AS column, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  sum({c})::DOUBLE AS total, count(*) FILTER (WHERE {c} = 0) AS zeros,
  count(*) FILTER (WHERE {c} < 0) AS negatives FROM panel""" for c in
                         ("event_count", "measure_sum", "high_count", "bright_a_max"))


@query("column_extrema", EXT)
def column_extrema(spark, d):
    return A.column_extrema(panel(spark, d), ["event_count", "measure_sum", "high_count",
                                              "bright_a_max"])


ARM = """SELECT '{arm}' AS arm, horizon,
  coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + fn, 0), 0) AS f1,
  coalesce(onset_hit::DOUBLE / nullif(onset, 0), 0) AS onset_recall,
  coalesce(cont_hit::DOUBLE / nullif(cont, 0), 0) AS continuation_recall FROM (SELECT horizon,
    count(*) FILTER (WHERE y_true = 1 AND {p} = 1) AS tp,
    count(*) FILTER (WHERE y_true = 0 AND {p} = 1) AS fp,
    count(*) FILTER (WHERE y_true = 1 AND {p} = 0) AS fn,
    count(*) FILTER (WHERE transition = 'N->E') AS onset,
    count(*) FILTER (WHERE transition = 'N->E' AND {p} = 1) AS onset_hit,
    count(*) FILTER (WHERE transition = 'E->E') AS cont,
    count(*) FILTER (WHERE transition = 'E->E' AND {p} = 1) AS cont_hit
    FROM scored GROUP BY horizon)"""
ARM_A = ARM.format(arm="first", p="y_pred")
ARM_B = ARM.format(arm="second", p="y_pred_b")


def arm_results(s, name, pred):
    from daymosaic.operators import metrics as M
    m = M.class_metrics(M.confusion(s, ["horizon"], pred=pred)).select("horizon", "f1")
    t = s.groupBy("horizon").agg(*[
        M.ratio_or_zero(F.count_if((F.col("transition") == k) & (F.col(pred) == 1)),
                        F.count_if(F.col("transition") == k)).alias(n)
        for k, n in (("N->E", "onset_recall"), ("E->E", "continuation_recall"))])
    return m.join(t, "horizon").withColumn("arm", F.lit(name))


@query("acceptance", f"""WITH r AS ({ARM_A} UNION ALL {ARM_B}),
  b AS ({ARM.format(arm='base', p='persistence')}),
  o AS (SELECT r.arm, avg(r.f1) AS average_f1, avg(b.f1) AS baseline_average_f1,
    count(*) FILTER (WHERE r.onset_recall - b.onset_recall > 0) AS onset_horizons_improved,
    max(r.f1 - b.f1) AS max_f1_delta, min(r.f1 - b.f1) AS min_f1_delta,
    min(r.continuation_recall - b.continuation_recall) AS min_continuation_delta
    FROM r JOIN b ON r.horizon = b.horizon GROUP BY r.arm)
  SELECT arm, round(average_f1, 9) AS average_f1, round(baseline_average_f1, 9)
    AS baseline_average_f1, onset_horizons_improved, max_f1_delta, min_f1_delta,
    min_continuation_delta, average_f1 >= baseline_average_f1 AS average_f1_ok,
    onset_horizons_improved >= 3 AS onset_ok, min_f1_delta >= -0.010 AS f1_drop_ok,
    min_continuation_delta >= -0.020 AS continuation_ok,
    average_f1 >= baseline_average_f1 AND onset_horizons_improved >= 3
      AND min_f1_delta >= -0.010 AND min_continuation_delta >= -0.020 AS accepted FROM o""")
def acceptance(spark, d):
    s = scored(spark, d)
    results = arm_results(s, "first", "y_pred").unionByName(arm_results(s, "second", "y_pred_b"))
    out = A.acceptance(results, arm_results(s, "base", "persistence"))
    return out.withColumns({c: F.round(c, 9) for c in ("average_f1", "baseline_average_f1")})


@query("year_totals", """SELECT year(date) AS year, sum(event_count)::BIGINT AS total FROM panel
  GROUP BY year(date)""")
def year_totals(spark, d):
    return P.year_totals(panel(spark, d))


@query("prob_summary", """SELECT horizon, transition, count(score) AS n, round(avg(score), 9) AS mean,
  round(quantile_cont(score, 0.10), 9) AS p10, round(quantile_cont(score, 0.25), 9) AS p25,
  round(quantile_cont(score, 0.50), 9) AS p50, round(quantile_cont(score, 0.75), 9) AS p75,
  round(quantile_cont(score, 0.90), 9) AS p90 FROM scored GROUP BY horizon, transition""")
def prob_summary(spark, d):
    out = A.prob_summary(scored(spark, d), ["horizon", "transition"], "score")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "p10", "p25", "p50", "p75", "p90")})


LENGTHS, POINTS, SMALL = (31, 365), (0.5, 0.9), 200


@query("sketch_windows", f"""WITH w AS (SELECT make_date(y, 12, 31) AS ending, days FROM (SELECT unnest(range(min(year(l_shipdate)),
    max(year(l_shipdate)) + 1))::INTEGER AS y FROM lineitem), (VALUES {", ".join(f"({n})" for n in LENGTHS)}) l(days))
  SELECT region, ending, days, count(*) AS n, true AS p50_within, true AS p90_within FROM ev JOIN w
    ON date <= ending AND ending - date < days GROUP BY ALL""")
def sketch_windows(spark, d):
    """Medians and 90th percentiles of the last month and of the whole of every year, from one table of day sketches; their
    ranks are counted on the rows of the window and must be within the sketches' error."""
    e = events(spark, d).select("region", "date", F.col("l_extendedprice").alias("price"))
    days = materialise(SK.day_sketches(e, ["region"], "price", SMALL), "day-sketches")
    ends = [dt.date(y, 12, 31) for y in years(spark, d)]
    q = materialise(SK.quantiles(SK.trailing(days, ["region"], ends, LENGTHS, SMALL), POINTS), "quantiles")
    inside = (F.col("date") <= F.col("ending")) & (F.datediff("ending", "date") < F.col("days"))
    j = e.join(F.broadcast(q), "region").filter(inside)  # a row for each region, year and length
    # the error holds for 99 windows in 100 a point; three times it for all of them
    slack = 3 * SK.rank_error(SMALL)

    def within(p):
        c = f"p{round(p * 100):02d}"
        below, upto = F.avg((F.col("price") < F.col(c)).cast("int")), F.avg((F.col("price") <= F.col(c)).cast("int"))
        return ((below - slack <= p) & (F.lit(p) <= upto + slack)).alias(f"{c}_within")
    return j.groupBy("region", "ending", "days", "n").agg(*[within(p) for p in POINTS])
