"""Lags, leads, rolling means, ranks, gaps, cumulative sums, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymosaic.functions.features import above
from daymosaic.operators import lags as L
from daymosaic.operators import metrics as M
from daymosaic.operators import panel as P
from daymosaic.operators import ranking as R
from daymosaic.operators.cleaning import latest
from daymosaic.suite.base import DAY_KEYS, KEYS, events, observed, panel, query, scored

PK = "p.region = {a}.region AND p.entity = {a}.entity"


def lag_sql(k: int, cols: dict[str, str]) -> tuple[str, str]:
    pick = ", ".join(f"a{k}.{c} AS {stem}_lag_{k}d" for c, stem in cols.items())
    return pick, (f"LEFT JOIN panel a{k} ON {PK.format(a=f'a{k}')} "
                  f"AND a{k}.date = p.date - {k}")


LAGS = [lag_sql(k, {"event_count": "event", "measure_sum": "measure"}) for k in L.DEFAULT_LAGS]


@query("lag_days", f"""SELECT p.region, p.entity, p.date, p.event_count, {', '.join(x for x, _ in LAGS)}
  FROM panel p {' '.join(j for _, j in LAGS)}""")
def lag_days(spark, d):
    return L.lag_days(panel(spark, d), KEYS, {"event_count": "event", "measure_sum": "measure"}
                      ).select(*DAY_KEYS, "event_count",
                               *[f"{s}_lag_{k}d" for k in L.DEFAULT_LAGS
                                 for s in ("event", "measure")])


LEADS = ", ".join(f"a{h}.event_count AS event_count_t_plus_{h}d" for h in L.DEFAULT_HORIZONS)
LEAD_JOINS = " ".join(f"LEFT JOIN panel a{h} ON {PK.format(a=f'a{h}')} AND a{h}.date = p.date + {h}"
                      for h in L.DEFAULT_HORIZONS)


@query("lead_days", f"SELECT p.region, p.entity, p.date, {LEADS} FROM panel p {LEAD_JOINS}")
def lead_days(spark, d):
    return L.lead_days(panel(spark, d), KEYS, ["event_count"]).select(
        *DAY_KEYS, *[f"event_count_t_plus_{h}d" for h in L.DEFAULT_HORIZONS])


@query("lag_days_sparse", """SELECT p.region, p.entity, p.date, p.event_count,
  a.event_count AS event_lag_1d, b.event_count AS event_lag_7d FROM obs p
  LEFT JOIN obs a ON p.region = a.region AND p.entity = a.entity AND a.date = p.date - 1
  LEFT JOIN obs b ON p.region = b.region AND p.entity = b.entity AND b.date = p.date - 7""")
def lag_days_sparse(spark, d):
    return L.lag_days(observed(spark, d), KEYS, {"event_count": "event"}, (1, 7)).select(
        *DAY_KEYS, "event_count", "event_lag_1d", "event_lag_7d")


W = "(PARTITION BY region, entity ORDER BY date)"


@query("lag_rows", f"""SELECT region, entity, date, lag(event_count, 1) OVER {W} AS event_lag_1d,
  lag(event_count, 3) OVER {W} AS event_lag_3d, lag(event_count, 7) OVER {W} AS event_lag_7d
  FROM panel""")
def lag_rows(spark, d):
    return L.lag_rows(panel(spark, d), KEYS, {"event_count": "event"}).select(
        *DAY_KEYS, "event_lag_1d", "event_lag_3d", "event_lag_7d")


@query("lead_rows", f"SELECT region, entity, date, lead(event_count) OVER {W} AS target FROM panel")
def lead_rows(spark, d):
    return L.lead_rows(panel(spark, d), KEYS, "event_count", "target").select(*DAY_KEYS, "target")


@query("rolling_mean_prev", """SELECT region, entity, date,
  CASE WHEN count(event_count) OVER w3 = 3 THEN avg(event_count) OVER w3 END AS event_mean_3d,
  CASE WHEN count(event_count) OVER w7 = 7 THEN avg(event_count) OVER w7 END AS event_mean_7d
  FROM panel WINDOW
  w3 AS (PARTITION BY region, entity ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w7 AS (PARTITION BY region, entity ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def rolling_mean_prev(spark, d):
    return L.rolling_mean_prev(panel(spark, d), KEYS, "event_count",
                               {"event_mean_3d": 3, "event_mean_7d": 7}
                               ).select(*DAY_KEYS, "event_mean_3d", "event_mean_7d")


@query("is_ordered", """SELECT region, entity, seq, date, previous_date FROM (
  SELECT *, lag(date) OVER (PARTITION BY region, entity ORDER BY seq, date) AS previous_date FROM (
    SELECT region, entity, date, max(l_orderkey) AS seq FROM ev GROUP BY ALL))
  WHERE previous_date > date""")
def is_ordered(spark, d):
    """Entity days in the order of their newest key; one row per day, so a group stays small."""
    seq = events(spark, d).groupBy("region", "entity", "date").agg(F.max("l_orderkey").alias("seq"))
    return L.is_ordered(seq, KEYS, ["seq", "date"]).select(*KEYS, "seq", "date", "previous_date")


@query("missing_dates", """SELECT b.region, b.entity, cast(g AS DATE) AS date FROM (
    SELECT region, entity, min(date) AS a, max(date) AS z FROM ev GROUP BY ALL) b,
    generate_series(b.a, b.z, INTERVAL 1 DAY) t(g)
  WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.region = b.region AND ev.entity = b.entity
    AND ev.date = cast(g AS DATE))""")
def missing_dates(spark, d):
    return P.missing_dates(events(spark, d), KEYS)


@query("continuous_history", """SELECT region, entity, count(DISTINCT date) AS days_present,
  min(date) AS first_date, max(date) AS last_date, max(date) - min(date) + 1 AS days_spanned,
  max(date) - min(date) + 1 - count(DISTINCT date) AS gap_days,
  (max(date) - min(date) + 1 = count(DISTINCT date)) AND count(DISTINCT date) >= 8 AS ready
  FROM ev GROUP BY region, entity""")
def continuous_history(spark, d):
    return P.continuous_history(events(spark, d), KEYS)


F1_SQL = """f AS (SELECT horizon, region, entity, count(*) AS total,
    sum(y_true)::BIGINT AS positives,
    count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp,
    count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
    count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn FROM scored GROUP BY ALL),
  g AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + fn, 0), 0.0) AS f1 FROM f)"""


@query("rank_entities", f"""WITH {F1_SQL} SELECT horizon, region, entity, positives, f1,
  row_number() OVER (PARTITION BY horizon ORDER BY f1 DESC, positives DESC, region, entity)
    AS rank_by_f1 FROM g""")
def rank_entities(spark, d):
    m = M.class_metrics(M.confusion(scored(spark, d), ["horizon", *KEYS]))
    return R.rank_within(m, ["horizon"], [F.col("f1").desc(), F.col("positives").desc(),
                                          F.col("region"), F.col("entity")], "rank_by_f1"
                         ).select("horizon", *KEYS, "positives", "f1", "rank_by_f1")


@query("group_share", """SELECT region, entity, date, event_count,
  event_count / nullif(sum(event_count) OVER (PARTITION BY region, date), 0)::DOUBLE AS share,
  max(event_count) OVER (PARTITION BY region, date) - event_count AS below_max FROM panel""")
def group_share(spark, d):
    return R.group_share(panel(spark, d), ["region", "date"], "event_count").select(
        *DAY_KEYS, "event_count", "share", "below_max")


@query("first_per_group", """SELECT region, entity, date, event_count FROM (SELECT *,
  row_number() OVER (PARTITION BY region, entity ORDER BY event_count DESC, date) AS rn FROM panel)
  WHERE rn = 1""")
def first_per_group(spark, d):
    return R.best_row(panel(spark, d), KEYS, [F.col("event_count").desc(), F.col("date")],
                      ["date", "event_count"])


@query("cumulative_by_score", """WITH g AS (SELECT horizon, score, count(*) AS n,
    sum(y_true)::BIGINT AS pos FROM scored GROUP BY ALL)
  SELECT horizon, score, n, pos,
    sum(n) OVER (PARTITION BY horizon ORDER BY score DESC)::BIGINT AS cum_n,
    sum(pos) OVER (PARTITION BY horizon ORDER BY score DESC)::BIGINT AS cum_pos FROM g""")
def cumulative_by_score(spark, d):
    from daymosaic.operators.running import logit_position, running_totals
    g = scored(spark, d).groupBy("horizon", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("pos"))
    return running_totals(g, ["horizon"], F.col("score").desc(),
                          logit_position(F.col("score"), True), ["n", "pos"]
                          ).select("horizon", "score", "n", "pos", "cum_n", "cum_pos")


@query("sort_keys", "SELECT region, entity, date, event_count FROM panel ORDER BY region, entity, date")
def sort_keys(spark, d):
    return panel(spark, d).select(*DAY_KEYS, "event_count").orderBy(*DAY_KEYS)


@query("mixed_sort", """SELECT date, region, entity, measure_sum FROM panel
  ORDER BY date DESC, measure_sum DESC, region, entity""")
def mixed_sort(spark, d):
    return panel(spark, d).select("date", *KEYS, "measure_sum").orderBy(
        F.col("date").desc(), F.col("measure_sum").desc(), "region", "entity")


@query("top_entity_days", """SELECT region, entity, date, event_count FROM panel
  ORDER BY event_count DESC, region, entity, date LIMIT 15""")
def top_entity_days(spark, d):
    return R.top_n(panel(spark, d).select(*DAY_KEYS, "event_count"),
                   [F.col("event_count").desc(), *[F.col(k) for k in DAY_KEYS]], 15)


@query("latest_day", """SELECT region, entity, date, event_count FROM obs
  WHERE date = (SELECT max(date) FROM obs)""")
def latest_day(spark, d):
    return latest(observed(spark, d), "date").select(*DAY_KEYS, "event_count")


@query("argmax_row", """SELECT region, date, entity, measure_sum FROM (SELECT *, row_number() OVER
  (PARTITION BY region, date ORDER BY measure_sum DESC, entity) AS rn FROM obs) WHERE rn = 1""")
def argmax_row(spark, d):
    return R.best_row(observed(spark, d), ["region", "date"],
                      [F.col("measure_sum").desc(), F.col("entity")], ["entity", "measure_sum"])


@query("dates_desc", "SELECT DISTINCT date FROM ev ORDER BY date DESC")
def dates_desc(spark, d):
    return R.dates_desc(events(spark, d), "date")


@query("flagship_persistence", """WITH h AS (
    SELECT p.region, p.entity, p.date, p.event_count, t.k AS horizon, f.event_count AS later
    FROM panel p, (VALUES (1), (2), (3), (5), (7)) t(k)
    JOIN panel f ON f.region = p.region AND f.entity = p.entity AND f.date = p.date + t.k
    JOIN panel b ON b.region = p.region AND b.entity = p.entity AND b.date = p.date - 14),
  c AS (SELECT region, horizon, count(*) AS total,
    count(*) FILTER (WHERE later > 2 AND event_count > 2) AS tp,
    count(*) FILTER (WHERE later <= 2 AND event_count <= 2) AS tn,
    count(*) FILTER (WHERE later <= 2 AND event_count > 2) AS fp,
    count(*) FILTER (WHERE later > 2 AND event_count <= 2) AS fn FROM h GROUP BY ALL)
  SELECT region, horizon, total, tp, tn, fp, fn,
    coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision,
    coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall,
    coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + fn, 0), 0.0) AS f1 FROM c""")
def flagship_persistence(spark, d):
    """Panel -> calendar lags and leads -> label -> persistence metrics per region."""
    f = L.lags_and_leads(panel(spark, d), KEYS, {"event_count": "event"},
                         lead_cols=["event_count"])
    f = f.filter(F.col("event_lag_14d").isNotNull())
    long = f.select("region", "event_count", F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"event_count_t_plus_{h}d").alias("later"))
        for h in L.DEFAULT_HORIZONS])).alias("t")).select("region", "event_count", "t.*")
    long = long.filter(F.col("later").isNotNull()).withColumns(
        {"y_true": above("later", 2), "y_pred": above("event_count", 2)})
    m = M.class_metrics(M.confusion(long, ["region", "horizon"]))
    return m.select("region", "horizon", "total", *M.CELLS, "precision", "recall", "f1")
