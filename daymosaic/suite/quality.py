"""Data checks on driver-derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymosaic.functions.features import above
from daymosaic.operators import lags as L
from daymosaic.operators import metrics as M
from daymosaic.operators import quality as Q
from daymosaic.plans import features as FT
from daymosaic.suite.base import DAY_KEYS, KEYS, define, entities, events, observed, panel, query, shared_panel, side
from daymosaic.suite.features import edges, full_lags

EV = {"event_count": "event"}


def counters(source: str, tests: dict[str, str]) -> str:
    """One row per test: how many rows of the source satisfy it."""
    return " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) FILTER (WHERE {t}) = 0 AS passed, "
        f"CAST(count(*) FILTER (WHERE {t}) AS VARCHAR) AS detail FROM {source}" for n, t in tests.items())


def counter(name: str, value: str) -> str:
    return f"SELECT '{name}' AS name, v = 0 AS passed, CAST(v AS VARCHAR) AS detail FROM (SELECT {value} AS v)"


@query("unique_key", counter("unique_key", "(SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)"))
def unique_key(spark, d):
    return Q.unique_key(events(spark, d), ["l_orderkey", "l_linenumber"])


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM ev GROUP BY ALL
  HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return Q.duplicate_keys(events(spark, d), ["l_orderkey", "l_linenumber"])


@query("require_columns", "SELECT region, entity, event_count FROM obs")
def require_columns(spark, d):
    from daymosaic.operators.cleaning import require_columns as need
    return need(observed(spark, d), [*DAY_KEYS, "event_count"]).select(*KEYS, "event_count")


def ranged(days: int) -> str:
    """The value so many days away, by a range frame."""
    side_ = "PRECEDING" if days < 0 else "FOLLOWING"
    at = f"INTERVAL {abs(days)} DAY {side_}"
    return f"max(event_count) OVER (PARTITION BY region, entity ORDER BY date RANGE BETWEEN {at} AND {at})"


def joined(days: int) -> str:
    """The same by a lookup of the shifted date."""
    return (f"(SELECT max(b.event_count) FROM panel b WHERE b.region = p.region AND b.entity = p.entity "
            f"AND b.date = p.date + {days})")


LAGS = {f"event_lag_{k}d": -k for k in L.DEFAULT_LAGS}
LEADS = {f"event_count_t_plus_{h}d": h for h in L.DEFAULT_HORIZONS}
define("moved", "SELECT *, " + ", ".join(f"{ranged(k)} AS {n}" for n, k in (LAGS | LEADS).items()) + " FROM panel",
       "panel")
define("moved2", "SELECT p.*, " + ", ".join(f"{joined(k)} AS j_{n}" for n, k in (LAGS | LEADS).items())
       + " FROM moved p", "moved")


@query("lag_aligned", counters("moved2", {n: f"{n} IS DISTINCT FROM j_{n}" for n in LAGS}))
def lag_aligned(spark, d):
    p = shared_panel(spark, d, "event_count")
    return Q.lag_aligned(L.lag_days(p, KEYS, EV), p, KEYS, EV, L.DEFAULT_LAGS)


@query("lag_rows_misaligned", """SELECT 'event_lag_' || k || 'd' AS name, n = 0 AS passed,
  CAST(n AS VARCHAR) AS detail FROM (SELECT k, count(*) FILTER (WHERE r IS DISTINCT FROM c) AS n FROM (
    SELECT t.k, CASE t.k WHEN 1 THEN lag(p.event_count, 1) OVER w WHEN 3 THEN lag(p.event_count, 3) OVER w
      ELSE lag(p.event_count, 7) OVER w END AS r, b.event_count AS c
    FROM panel p CROSS JOIN (VALUES (1), (3), (7)) t(k) LEFT JOIN panel b ON b.region = p.region
      AND b.entity = p.entity AND b.date = p.date - t.k
    WINDOW w AS (PARTITION BY p.region, p.entity, t.k ORDER BY p.date)) GROUP BY k)""")
def lag_rows_misaligned(spark, d):
    """The audit finds the rows where a positional lag crosses a season gap."""
    p = shared_panel(spark, d, "event_count")
    return Q.lag_aligned(L.lag_rows(p, KEYS, EV), p, KEYS, EV, (1, 3, 7))


@query("target_aligned", counters("moved2", {n: f"{n} IS DISTINCT FROM j_{n}" for n in LEADS} | {
    "target": "(event_count_t_plus_1d > 2) IS DISTINCT FROM (j_event_count_t_plus_1d > 2)"}))
def target_aligned(spark, d):
    p = shared_panel(spark, d, "event_count")
    f = L.lead_days(p, KEYS, ["event_count"]).withColumn("target", above("event_count_t_plus_1d", 2))
    return Q.target_aligned(f, p, KEYS, ["event_count"], L.DEFAULT_HORIZONS, "target")


@query("no_leakage", """WITH j AS (SELECT p.event_count, p.measure_sum, f.event_count AS t FROM panel p
    LEFT JOIN panel f ON f.region = p.region AND f.entity = p.entity AND f.date = p.date + 1)
  SELECT n || '_is_not_event_count_t_plus_1d' AS name, v > 0 AS passed, CAST(v AS VARCHAR) AS detail FROM (
    SELECT 'event_count' AS n, count(*) FILTER (WHERE event_count IS DISTINCT FROM t) AS v FROM j
    UNION ALL SELECT 'measure_sum', count(*) FILTER (WHERE measure_sum IS DISTINCT FROM t) FROM j)
  UNION ALL SELECT n, true, '0' FROM (VALUES ('no_future_names'), ('distinct_names'), ('targets_excluded')) t(n)""")
def no_leakage(spark, d):
    f = L.lead_days(panel(spark, d), KEYS, ["event_count"], (1,))
    return Q.no_leakage(f, ["event_count", "measure_sum"], ["event_count_t_plus_1d"])


@query("season_boundary", counters("moved", {n: f"{n} IS NOT NULL AND (month(date + {k}) NOT IN (10, 11) "
                                            f"OR year(date + {k}) <> year(date))" for n, k in (LAGS | LEADS).items()}))
def season_boundary(spark, d):
    f = L.lags_and_leads(panel(spark, d).select(*DAY_KEYS, "event_count"), KEYS, EV,
                         lead_cols=["event_count"])
    return Q.season_boundary(f, KEYS, EV, L.DEFAULT_LAGS, {"event_count": L.DEFAULT_HORIZONS})


@query("season_boundary_rows", """SELECT 'event_lag_' || k || 'd' AS name, n = 0 AS passed,
  CAST(n AS VARCHAR) AS detail FROM (SELECT k, count(*) FILTER (WHERE (month(date - k) NOT IN (10, 11)
      OR year(date - k) <> year(date)) AND rn > k) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY region, entity ORDER BY date) AS rn FROM panel),
      (VALUES (1), (3), (7)) t(k) GROUP BY k)""")
def season_boundary_rows(spark, d):
    f = L.lag_rows(panel(spark, d).select(*DAY_KEYS, "event_count"), KEYS, EV)
    return Q.season_boundary(f, KEYS, EV, (1, 3, 7), {})


@query("key_consistency", """SELECT 'keys_missing_in_source' AS name, count(*) = 0 AS passed,
    CAST(count(*) AS VARCHAR) AS detail FROM full_lags f ANTI JOIN panel p ON p.region = f.region
    AND p.entity = f.entity AND p.date = f.date
  UNION ALL SELECT 'entities_in_many_regions', count(*) = 0, CAST(count(*) AS VARCHAR) FROM (
    SELECT entity FROM full_lags GROUP BY entity HAVING count(DISTINCT region) > 1)""")
def key_consistency(spark, d):
    p = shared_panel(spark, d, "event_count", "measure_sum")
    return Q.key_consistency(full_lags(spark, d, p), p, DAY_KEYS)


COVERAGE = """WITH g AS (SELECT region, entity, year(date) AS y, count(*) AS n,
    max(date) - min(date) + 1 - count(*) AS missing FROM {t} GROUP BY ALL)
  SELECT 'missing_days' AS name, sum(missing) = 0 AS passed, CAST(sum(missing) AS VARCHAR) AS detail FROM g
  UNION ALL SELECT 'years_with_unequal_rows', count(*) = 0, CAST(count(*) AS VARCHAR) FROM (
    SELECT y FROM g GROUP BY y HAVING count(DISTINCT n) > 1)"""


@query("coverage_check", COVERAGE.format(t="obs"))
def coverage_check(spark, d):
    return Q.coverage(observed(spark, d), KEYS)


@query("coverage_check_panel", COVERAGE.format(t="panel"))
def coverage_check_panel(spark, d):
    return Q.coverage(shared_panel(spark, d, "event_count"), KEYS)


@query("distribution_check", " UNION ALL ".join(f"""SELECT 'event_count_t_plus_{h}d_not_negative' AS name,
    true AS passed, '0' AS detail UNION ALL SELECT 'event_count_t_plus_{h}d_has_positives', count(*) > 0,
    CAST(count(*) AS VARCHAR) FROM panel p JOIN panel f ON f.region = p.region AND f.entity = p.entity
    AND f.date = p.date + {h} WHERE f.event_count > 2""" for h in (1, 7)))
def distribution_check(spark, d):
    f = L.lead_days(panel(spark, d), KEYS, ["event_count"], (1, 7))
    return Q.distribution(f, "event_count", (1, 7))


@query("metrics_finite", """WITH c AS (SELECT count(*) FILTER (WHERE a > 2 AND b > 2) AS tp,
    count(*) FILTER (WHERE a > 2 AND b <= 2) AS fp, count(*) FILTER (WHERE a <= 2 AND b > 2) AS fn,
    count(*) FILTER (WHERE a <= 2 AND b <= 2) AS tn FROM (SELECT event_count AS a, event_count_t_plus_1d AS b
      FROM moved WHERE event_count_t_plus_1d IS NOT NULL)),
  m AS (SELECT 'accuracy' AS name, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS v FROM c
    UNION ALL SELECT 'precision', coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) FROM c
    UNION ALL SELECT 'recall', coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) FROM c
    UNION ALL SELECT 'f1', coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) FROM c
    UNION ALL SELECT 'fp_rate', fp::DOUBLE / nullif(fp + tn, 0) FROM c)
  SELECT name, coalesce(isfinite(v), false) AS passed, CASE WHEN isfinite(v) THEN '0' ELSE '1' END AS detail FROM m""")
def metrics_finite(spark, d):
    f = L.lead_days(panel(spark, d), KEYS, ["event_count"], (1,)).dropna(subset=["event_count_t_plus_1d"])
    f = f.withColumns({"y_true": above("event_count_t_plus_1d", 2), "y_pred": above("event_count", 2)})
    return Q.metrics_finite(M.class_metrics(M.confusion(f, [])),
                            ["accuracy", "precision", "recall", "f1", "fp_rate"])


@query("tables_equal_except", """WITH a AS (SELECT region, entity, date, event_count, high_count,
    measure_sum FROM panel),
  b AS (SELECT region, entity, date, event_count, CASE WHEN high_count > 1 THEN NULL ELSE high_count END
    AS high_count, measure_sum + 1 AS measure_sum FROM panel),
  j AS (SELECT a.region AS ra, b.region AS rb, a.event_count AS ea, b.event_count AS eb, a.high_count AS ha,
    b.high_count AS hb FROM a FULL JOIN b ON a.region = b.region AND a.entity = b.entity AND a.date = b.date),
  c AS (SELECT count(*) FILTER (WHERE ra IS NULL OR rb IS NULL) AS k,
    count(*) FILTER (WHERE ea IS DISTINCT FROM eb) AS e, count(*) FILTER (WHERE (ea IS NULL) <> (eb IS NULL)) AS en,
    count(*) FILTER (WHERE ha IS DISTINCT FROM hb) AS h, count(*) FILTER (WHERE (ha IS NULL) <> (hb IS NULL)) AS hn
    FROM j)
  SELECT 'same_columns' AS name, true AS passed, '6' AS detail UNION ALL
  SELECT 'same_keys', k = 0, CAST(k AS VARCHAR) FROM c UNION ALL
  SELECT 'event_count', e = 0 AND en = 0, e || '/' || en FROM c UNION ALL
  SELECT 'high_count', h = 0 AND hn = 0, h || '/' || hn FROM c""")
def tables_equal_except(spark, d):
    a = shared_panel(spark, d, "event_count", "high_count", "measure_sum")
    b = a.withColumns({"measure_sum": F.col("measure_sum") + 1,
                       "high_count": F.when(F.col("high_count") <= 1, F.col("high_count"))})
    return Q.tables_equal_except(a, b, DAY_KEYS, ["measure_sum"])


INTERACT = " UNION ALL ".join(f"""SELECT '{product}' AS name, l.{own} * n.{near} AS v, n.{near} * l.{own} AS w
    FROM lagged l LEFT JOIN near_lags n ON n.region = l.region AND n.entity = l.entity AND n.date = l.date
  UNION ALL SELECT '{ratio}', n.{near} / (l.{own} + 1), n.{near} / (l.{own} + 1) FROM lagged l
    LEFT JOIN near_lags n ON n.region = l.region AND n.entity = l.entity AND n.date = l.date"""
                              for product, ratio, own, near in FT.interaction_pairs())


@query("reconstruct", f"""WITH v AS ({INTERACT}) SELECT name, count(*) FILTER (WHERE abs(v - w) > 1e-12) = 0 AS passed,
  CAST(count(*) FILTER (WHERE abs(v - w) > 1e-12) AS VARCHAR) AS detail FROM v GROUP BY name""")
def reconstruct(spark, d):
    p = shared_panel(spark, d, "event_count", "measure_sum")
    f = FT.features_neighbour(full_lags(spark, d, p), p, edges(spark, d))
    return Q.reconstruct(FT.features_interaction(f), FT.interaction_columns())


@query("numbers_match", """WITH a AS (SELECT 'rows ' || region AS "check", count(*)::DOUBLE AS actual FROM ev
    GROUP BY region),
  e AS (SELECT 'rows ' || r_name AS "check", CASE r_name WHEN 'ASIA' THEN NULL WHEN 'EUROPE' THEN -1.0
    ELSE (SELECT actual FROM a WHERE a."check" = 'rows ' || r_name) END AS expected FROM region
    UNION ALL SELECT 'rows NOWHERE', 1.0)
  SELECT e."check", expected, actual, CASE WHEN expected IS NULL THEN 'INFO' WHEN actual IS NULL THEN 'MISSING'
    WHEN abs(actual - expected) <= 5e-4 THEN 'PASS' ELSE 'MISMATCH' END AS status
  FROM e LEFT JOIN a ON a."check" = e."check" """)
def numbers_match(spark, d):
    a = events(spark, d).groupBy(F.concat(F.lit("rows "), "region").alias("check")).agg(
        F.count(F.lit(1)).cast("double").alias("actual"))
    e = a.select("check", F.when(F.col("check") == "rows ASIA", F.lit(None)).when(
        F.col("check") == "rows EUROPE", -1.0).otherwise(F.col("actual")).alias("expected"))
    e = e.unionByName(spark.range(1).select(F.lit("rows NOWHERE").alias("check"), F.lit(1.0).alias("expected")))
    return Q.numbers_match(e, a)


@query("manifest_valid", """WITH m AS (SELECT CASE WHEN event_type = 'error' THEN 'bad'
    ELSE strftime(ts, '%Y-%m-%d') END AS date, CAST(user_id % 5 AS VARCHAR) AS region,
    CASE WHEN user_id = 7 THEN ' ' ELSE CAST(user_id AS VARCHAR) END AS entity,
    CASE WHEN event_type = 'view' THEN 'SEEN' ELSE 'OBSERVED' END AS state FROM events),
  c AS (SELECT count(*) FILTER (WHERE TRY_CAST(date AS DATE) IS NULL) AS a,
    count(*) FILTER (WHERE state = 'SEEN') AS b, count(*) FILTER (WHERE trim(entity) = '') AS c,
    count(*) - count(DISTINCT (date, region, entity)) AS d FROM m)
  SELECT 'invalid_dates' AS name, a = 0 AS passed, CAST(a AS VARCHAR) AS detail FROM c
  UNION ALL SELECT 'invalid_states', b = 0, CAST(b AS VARCHAR) FROM c
  UNION ALL SELECT 'blank_identity', c = 0, CAST(c AS VARCHAR) FROM c
  UNION ALL SELECT 'duplicate_keys', d = 0, CAST(d AS VARCHAR) FROM c""")
def manifest_valid(spark, d):
    from daymosaic.suite.base import table
    e = table(spark, d, "events")
    m = e.select(
        F.when(F.col("event_type") == "error", "bad").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        (F.col("user_id") % 5).cast("string").alias("region"),
        F.when(F.col("user_id") == 7, " ").otherwise(F.col("user_id").cast("string")).alias("entity"),
        F.when(F.col("event_type") == "view", "SEEN").otherwise("OBSERVED").alias("observation_status"),
        F.lit("sensor").alias("source"), F.lit("log").alias("evidence_file"))
    return Q.manifest_valid(m)


@query("coverage_evidence", """SELECT 'detections' AS evidence, count(*) AS rows, count(DISTINCT entity) AS entities,
    count(DISTINCT region) AS regions, min(date) AS first_date, max(date) AS last_date,
    NULL::BIGINT AS confirmed FROM ev
  UNION ALL SELECT 'manifest', count(*), NULL, NULL, NULL, NULL, count(*) FILTER (WHERE status = 'SUCCESS') FROM winman
  UNION ALL SELECT 'features', count(*), count(DISTINCT entity), count(DISTINCT region), min(date), max(date),
    count(*) FILTER (WHERE event_lag_1d > 0) FROM full_lags""")
def coverage_evidence(spark, d):
    from daymosaic.suite.sources import manifest
    f = full_lags(spark, d).withColumn("ready", F.col("event_lag_1d") > 0)
    return Q.coverage_evidence(events(spark, d), manifest(spark, d), f)


@query("conservation", """SELECT n AS name, abs(v - (SELECT count(*) FROM ev WHERE month(date) IN (10, 11))) <= 1e-6 AS passed,
  CAST(CAST(v AS DOUBLE) AS VARCHAR) AS detail FROM (
    SELECT 'entity_days' AS n, sum(event_count) AS v FROM obs
    UNION ALL SELECT 'panel', sum(event_count) FROM panel
    UNION ALL SELECT 'cell_days', sum(event_count) FROM celldays WHERE month(date) IN (10, 11))""")
def conservation(spark, d):
    from daymosaic.functions.calendar import in_season
    from daymosaic.suite.aggregates import cell_days
    from daymosaic.suite.base import season_events
    raw = season_events(spark, d).withColumn("event_count", F.lit(1))
    stages = {"events": raw, "entity_days": observed(spark, d), "panel": panel(spark, d),
              "cell_days": cell_days(spark, d).filter(in_season("date"))}
    out = Q.conservation(stages, {n: "event_count" for n in stages})
    return out.withColumn("detail", F.col("detail").cast("double").cast("string"))


@query("weights_sum_to_one", counters("(SELECT sum(area_weight) AS t FROM half_weights GROUP BY region, grid_x, grid_y)",
                                       {"weights_off_one": "abs(t - 1) > 1e-10"}))
def weights_sum_to_one(spark, d):
    from daymosaic.operators.spatial import overlap_weights
    from daymosaic.suite.spatial import overlaps
    return Q.weights_sum_to_one(overlap_weights(overlaps(spark, d)), ["region", "grid_x", "grid_y"])


@query("null_only_when", counters("panel_nulls", {c: f"{c} IS NULL AND event_count <> 0"
                                                  for c in ("measure_mean", "measure_max")}))
def null_only_when(spark, d):
    from daymosaic.suite.joins import zero_fill_counts_only
    return Q.null_only_when(zero_fill_counts_only(spark, d), ["measure_mean", "measure_max"],
                            F.col("event_count") == 0)


@query("complete_panel", """WITH c AS (SELECT count(*) AS n, count(DISTINCT (region, entity)) AS e,
    count(DISTINCT date) AS d, count(DISTINCT (region, entity, date)) AS k FROM panel)
  SELECT 'complete_panel' AS name, n = e * d AS passed, CAST(n - e * d AS VARCHAR) AS detail FROM c
  UNION ALL SELECT 'unique_key', n = k, CAST(n - k AS VARCHAR) FROM c""")
def complete_panel(spark, d):
    return Q.complete_panel(shared_panel(spark, d, "event_count"), KEYS)


@query("complete_panel_sparse", """WITH c AS (SELECT count(*) AS n, count(DISTINCT (region, entity)) AS e,
    count(DISTINCT date) AS d, count(DISTINCT (region, entity, date)) AS k FROM obs)
  SELECT 'complete_panel' AS name, n = e * d AS passed, CAST(n - e * d AS VARCHAR) AS detail FROM c
  UNION ALL SELECT 'unique_key', n = k, CAST(n - k AS VARCHAR) FROM c""")
def complete_panel_sparse(spark, d):
    return Q.complete_panel(observed(spark, d), KEYS)


@query("implementations_agree", """WITH c AS (SELECT count(*) FILTER (WHERE a.region IS NOT NULL AND b.region IS NULL) AS l,
    count(*) FILTER (WHERE a.region IS NULL) AS r, max(abs(a.event_lag_3d - b.j_event_lag_3d)) AS m
    FROM moved a FULL JOIN moved2 b ON a.region = b.region AND a.entity = b.entity AND a.date = b.date)
  SELECT 'keys_left_only' AS name, l = 0 AS passed, CAST(l AS VARCHAR) AS detail FROM c UNION ALL
  SELECT 'keys_right_only', r = 0, CAST(r AS VARCHAR) FROM c UNION ALL
  SELECT 'values_equal', coalesce(m <= 1e-6, true), CAST(m AS VARCHAR) FROM c""")
def implementations_agree(spark, d):
    p = shared_panel(spark, d, "event_count")
    a = L.lag_days(p, KEYS, EV, (3,))
    b = L.lag_days_by_join(p, KEYS, EV, (3,))
    return Q.implementations_agree(a, b, DAY_KEYS, "event_lag_3d")


@query("target_same", """WITH c AS (SELECT count(*) FILTER (WHERE a.region IS NULL OR b.region IS NULL) AS k,
    count(*) FILTER (WHERE a.event_count_t_plus_1d IS DISTINCT FROM b.event_count_t_plus_1d) AS t
    FROM moved a FULL JOIN (SELECT m.* FROM moved m JOIN side s ON s.region = m.region AND s.entity = m.entity
      AND s.date = m.date) b ON a.region = b.region AND a.entity = b.entity AND a.date = b.date)
  SELECT 'same_rows' AS name, k = 0 AS passed, CAST(k AS VARCHAR) AS detail FROM c UNION ALL
  SELECT 'same_targets', t = 0, CAST(t AS VARCHAR) FROM c""")
def target_same(spark, d):
    f = L.lead_days(shared_panel(spark, d, "event_count"), KEYS, ["event_count"], (1,))
    arm = f.join(side(spark, d), DAY_KEYS)
    return Q.target_same(f, arm, DAY_KEYS, "event_count_t_plus_1d")
