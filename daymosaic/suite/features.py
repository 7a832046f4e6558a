"""Scalar feature functions and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymosaic.functions import features as X
from daymosaic.functions import numeric as N
from daymosaic.functions.calendar import cycle, day_of_season, with_date_parts
from daymosaic.operators import lags as L
from daymosaic.operators import metrics as M
from daymosaic.operators import panel as P
from daymosaic.operators.neighbours import neighbour_context, neighbour_mean
from daymosaic.plans import features as FT
from daymosaic.suite.base import (DAY_KEYS, KEYS, define, entities, events, panel,
                                  query, scored, shared_panel, side, table)

PK = "{a}.region = p.region AND {a}.entity = p.entity"


def shifted(k: int, sign: str = "-", src: str = "panel") -> str:
    a = f"{'b' if sign == '-' else 'f'}{k}"
    return f"LEFT JOIN {src} {a} ON {PK.format(a=a)} AND {a}.date = p.date {sign} {k}"


LAG_COLS = ", ".join(f"b{k}.event_count AS event_lag_{k}d, b{k}.measure_sum AS measure_lag_{k}d"
                     for k in L.DEFAULT_LAGS)
LEAD_COLS = ", ".join(f"f{h}.event_count AS event_count_t_plus_{h}d, "
                      f"f{h}.measure_sum AS measure_sum_t_plus_{h}d" for h in L.DEFAULT_HORIZONS)


def mean_sql(stem: str, ks, alias: str) -> str:
    return (f"({' + '.join(f'{stem}_lag_{k}d' for k in ks)})::DOUBLE / {len(ks)}.0::DOUBLE AS {alias}")


MEANS = ", ".join(mean_sql(s, ks, f"{s}_{n}") for s in ("event", "measure")
                  for n, ks in FT.SPARSE.items())

define("lagged", f"""SELECT p.region, p.entity, p.date, p.event_count, p.measure_sum, {LAG_COLS}
  FROM panel p {' '.join(shifted(k) for k in L.DEFAULT_LAGS)}""", "panel")
define("full_lags", f"""SELECT *, {MEANS} FROM lagged WHERE event_lag_14d IS NOT NULL
  AND event_lag_7d IS NOT NULL AND event_lag_5d IS NOT NULL AND event_lag_3d IS NOT NULL
  AND event_lag_2d IS NOT NULL AND event_lag_1d IS NOT NULL""", "lagged")


def full_lags(spark, d, p=None):
    p = panel(spark, d) if p is None else p
    f = L.lag_days(p.select(*DAY_KEYS, "event_count", "measure_sum"), KEYS, FT.STEMS)
    f = f.dropna(subset=[f"{s}_lag_{k}d" for s in FT.STEMS.values() for k in L.DEFAULT_LAGS])
    return FT.with_sparse_means(f, list(FT.STEMS.values()), skip_null=True)


@query("date_parts", """SELECT region, entity, date, year(date)::INTEGER AS year,
  month(date)::INTEGER AS month, day(date)::INTEGER AS day,
  (date - make_date(year(date), 10, 1) + 1)::INTEGER AS day_of_season FROM panel""")
def date_parts(spark, d):
    return with_date_parts(panel(spark, d).select(*DAY_KEYS))


@query("day_of_season", """SELECT date, (date - make_date(year(date), 10, 1) + 1)::INTEGER AS dos,
  count(*) AS n FROM ev GROUP BY ALL""")
def day_of_season_(spark, d):
    return events(spark, d).groupBy("date", day_of_season("date").alias("dos")).agg(
        F.count(F.lit(1)).alias("n"))


@query("cyclic_encoding", """SELECT DISTINCT date, round(sin(2 * pi() * dayofyear(date) / 365.25), 9)
  AS sin_year, round(cos(2 * pi() * dayofyear(date) / 365.25), 9) AS cos_year,
  round(sin(2 * pi() * (date - make_date(year(date), 10, 1) + 1) / 61), 9) AS season_sin,
  round(cos(2 * pi() * (date - make_date(year(date), 10, 1) + 1) / 61), 9) AS season_cos FROM ev""")
def cyclic_encoding(spark, d):
    days = events(spark, d).select("date").distinct()
    a, b = cycle(F.dayofyear("date"), FT.YEAR_PERIOD)
    c, e = cycle(day_of_season("date"), FT.SEASON_PERIOD)
    return days.select("date", *[F.round(x, 9).alias(n) for n, x in (
        ("sin_year", a), ("cos_year", b), ("season_sin", c), ("season_cos", e))])


@query("date_arithmetic", """SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) + 3 AS later,
  CAST(ts AS DATE) - 2 AS earlier FROM events""")
def date_arithmetic(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").select(
        "event_id", day.alias("day"), F.date_add(day, 3).alias("later"),
        F.date_sub(day, 2).alias("earlier"))


@query("row_mean_policies", """SELECT region, entity, date,
  (event_lag_1d + event_lag_2d + event_lag_3d)::DOUBLE / 3.0::DOUBLE AS strict_mean,
  CASE WHEN event_lag_1d IS NULL AND event_lag_2d IS NULL AND event_lag_3d IS NULL THEN NULL ELSE
    (coalesce(event_lag_1d, 0) + coalesce(event_lag_2d, 0) + coalesce(event_lag_3d, 0))::DOUBLE /
    ((event_lag_1d IS NOT NULL)::INT + (event_lag_2d IS NOT NULL)::INT
      + (event_lag_3d IS NOT NULL)::INT)::DOUBLE END AS skip_mean FROM lagged""")
def row_mean_policies(spark, d):
    f = L.lag_days(panel(spark, d), KEYS, {"event_count": "event"}, (1, 2, 3))
    cols = [f"event_lag_{k}d" for k in (1, 2, 3)]
    return f.select(*DAY_KEYS, X.row_mean(cols, False).alias("strict_mean"),
                    X.row_mean(cols, True).alias("skip_mean"))


@query("sparse_means", f"SELECT region, entity, date, {MEANS} FROM full_lags_base".replace(
    "full_lags_base", "lagged WHERE event_lag_14d IS NOT NULL"))
def sparse_means(spark, d):
    return full_lags(spark, d).select(*DAY_KEYS, *[f"{s}_{n}" for s in FT.STEMS.values()
                                                   for n in FT.SPARSE])


def trend_sql(s: str) -> str:
    return f"""{s}_lag_1d - {s}_lag_2d AS {s}_change_1d, {s}_lag_1d - {s}_lag_3d AS {s}_change_3d,
  {s}_lag_1d - {s}_lag_7d AS {s}_change_7d,
  {s}_lag_1d / ({s}_mean_3d + 1e-6::DOUBLE) AS {s}_ratio_recent_vs_3d,
  {s}_lag_1d / ({s}_sparse_mean_7d + 1e-6::DOUBLE) AS {s}_ratio_recent_vs_7d,
  ({s}_lag_1d - {s}_lag_3d)::DOUBLE / 2.0::DOUBLE AS {s}_trend_3d,
  (2 * {s}_lag_1d + {s}_lag_2d - {s}_lag_5d - 2 * {s}_lag_7d)::DOUBLE / 10.0::DOUBLE AS {s}_trend_7d,
  ({s}_lag_1d - {s}_lag_2d) - ({s}_lag_2d - {s}_lag_3d) AS {s}_acceleration"""


@query("features_trend", f"""SELECT region, entity, date, {trend_sql('event')}, {trend_sql('measure')}
  FROM full_lags""")
def features_trend(spark, d):
    f = FT.features_trend(full_lags(spark, d))
    return f.select(*DAY_KEYS, *[c for s in FT.STEMS.values() for c in FT.trend_columns(s)])


# entities of one region are each other's neighbours
define("edges", """SELECT a.region, a.entity, b.region AS neighbor_region, b.entity AS neighbor FROM ent a JOIN ent b
  ON a.region = b.region AND a.entity <> b.entity""", "ent")


def edges(spark, d):
    e = entities(spark, d)
    a = e.select("region", "entity")
    b = e.select("region", F.col("entity").alias("neighbor"))
    return a.join(b, "region").filter("entity <> neighbor").select(
        "region", "entity", F.col("region").alias("neighbor_region"), "neighbor")


define("near", """SELECT e.region, e.entity, p.date, avg(p.event_count) AS neighbor_event_current,
  avg(p.measure_sum) AS neighbor_measure_current FROM panel p JOIN edges e ON e.neighbor = p.entity
    AND e.neighbor_region = p.region GROUP BY e.region, e.entity, p.date""", "panel", "edges")


@query("neighbour_mean", "SELECT * FROM near")
def neighbour_mean_(spark, d):
    return neighbour_mean(panel(spark, d), edges(spark, d),
                          {"event_count": "neighbor_event_current",
                           "measure_sum": "neighbor_measure_current"})


NEAR_LAGS = ", ".join(f"n{k}.neighbor_event_current AS neighbor_event_lag_{k}d, "
                      f"n{k}.neighbor_measure_current AS neighbor_measure_lag_{k}d" for k in (1, 3, 7))
NEAR_JOINS = " ".join(f"LEFT JOIN near n{k} ON n{k}.region = n.region AND n{k}.entity = n.entity AND n{k}.date = n.date - {k}"
                      for k in (1, 3, 7))
define("near_lags", f"SELECT n.*, {NEAR_LAGS} FROM near n {NEAR_JOINS}", "near")


@query("neighbour_context", "SELECT * FROM near_lags")
def neighbour_context_(spark, d):
    return neighbour_context(panel(spark, d), edges(spark, d), FT.STEMS)


@query("neighbour_context_own_history", f"""SELECT n.*, {', '.join(
    f"b{k}.event_count AS neighbor_event_lag_{k}d, b{k}.measure_sum AS neighbor_measure_lag_{k}d"
    for k in (1, 3, 7))} FROM near n {' '.join(
    f'LEFT JOIN panel b{k} ON b{k}.region = n.region AND b{k}.entity = n.entity AND b{k}.date = n.date - {k}'
    for k in (1, 3, 7))}""")
def neighbour_context_own_history(spark, d):
    return neighbour_context(shared_panel(spark, d, "event_count", "measure_sum"), edges(spark, d), FT.STEMS,
                             own_history=True)


def interaction_sql() -> str:
    out = []
    for col, stem in FT.STEMS.items():
        for when in ("current", "lag_1d", "lag_3d", "lag_7d"):
            own = f"l.{col}" if when == "current" else f"l.{stem}_{when}"
            near = f"n.neighbor_{stem}_{when}"
            out.append(f"{own} * {near} AS {stem}_neighbor_interaction_{when}")
            out.append(f"{near} / ({own} + 1) AS neighbor_{stem}_relative_{when}")
    return ", ".join(out)


@query("features_interaction", f"""SELECT l.region, l.entity, l.date, {interaction_sql()}
  FROM lagged l LEFT JOIN near_lags n ON l.region = n.region AND l.entity = n.entity AND l.date = n.date
  WHERE l.event_lag_14d IS NOT NULL""")
def features_interaction(spark, d):
    p = shared_panel(spark, d, "event_count", "measure_sum")
    f = FT.features_neighbour(full_lags(spark, d, p), p, edges(spark, d))
    return FT.features_interaction(f).select(*DAY_KEYS, *FT.interaction_columns())


@query("features_neighbour", """SELECT l.region, l.entity, l.date, n.neighbor_event_current,
  n.neighbor_event_lag_1d, n.neighbor_event_lag_7d, n.neighbor_measure_lag_3d FROM lagged l
  LEFT JOIN near_lags n ON l.region = n.region AND l.entity = n.entity AND l.date = n.date
  WHERE l.event_lag_14d IS NOT NULL""")
def features_neighbour(spark, d):
    p = shared_panel(spark, d, "event_count", "measure_sum")
    f = FT.features_neighbour(full_lags(spark, d, p), p, edges(spark, d))
    return f.select(*DAY_KEYS, "neighbor_event_current", "neighbor_event_lag_1d",
                    "neighbor_event_lag_7d", "neighbor_measure_lag_3d")


@query("guarded_ratio", """SELECT region, entity, date,
  CASE WHEN event_count > 0 THEN high_count / event_count::DOUBLE ELSE 0 END AS high_share,
  coalesce(day_count / nullif(night_count, 0)::DOUBLE, 0) AS day_to_night_or_zero,
  day_count / nullif(night_count, 0)::DOUBLE AS day_to_night_or_null FROM panel""")
def guarded_ratio(spark, d):
    return panel(spark, d).select(
        *DAY_KEYS, X.share_or_zero("high_count", "event_count").alias("high_share"),
        N.ratio_or_zero("day_count", "night_count").alias("day_to_night_or_zero"),
        N.ratio_or_null("day_count", "night_count").alias("day_to_night_or_null"))


@query("clip_logit_sigmoid", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(ln(q / (1 - q)), 9) AS logit, round(1 / (1 + exp(-ln(q / (1 - q)))), 9) AS back FROM (
  SELECT *, least(greatest(score, 1e-6::DOUBLE), (1 - 1e-6::DOUBLE)) AS q FROM scored)""")
def clip_logit_sigmoid(spark, d):
    z = N.logit("score")
    return scored(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                   F.round(z, 9).alias("logit"),
                                   F.round(N.sigmoid(z), 9).alias("back"))


@query("tolerance_equality", """SELECT count(*) AS n,
  count(*) FILTER (WHERE abs(measure_mean - bright_b_mean) <= 250) AS close,
  count(*) FILTER (WHERE measure_mean = measure_max) AS same FROM panel""")
def tolerance_equality(spark, d):
    return panel(spark, d).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(N.close_to("measure_mean", "bright_b_mean", 250.0)).alias("close"),
        F.count_if(N.close_to("measure_mean", "measure_max")).alias("same"))


@query("rounding", """SELECT event_id, round(value * 100 / 7, 4) AS metric, round(value / 500, 6)
  AS threshold FROM events""")
def rounding(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.round(F.col("value") * 100 / 7, 4).alias("metric"),
        F.round(F.col("value") / 500, 6).alias("threshold"))


@query("binning", """SELECT CASE WHEN count_now <= 0 THEN 'none' WHEN count_now <= 2 THEN 'low'
    ELSE 'elevated' END AS level,
  (SELECT max(k) FROM range(10) t(k) WHERE score >= k / 10.0::DOUBLE)::INTEGER AS left_bin,
  (SELECT max(k) FROM range(10) t(k) WHERE k = 0 OR score > k / 10.0::DOUBLE)::INTEGER AS right_bin,
  count(*) AS n FROM scored GROUP BY ALL""")
def binning(spark, d):
    s = scored(spark, d).select(
        N.label_bins("count_now", [0, 2], ["none", "low", "elevated"]).alias("level"),
        N.equal_width_bin("score", 10, "left").alias("left_bin"),
        N.equal_width_bin("score", 10, "right").alias("right_bin"))
    return s.groupBy(*s.columns).agg(F.count(F.lit(1)).alias("n"))


@query("json_map_array", """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k,
  len(json_keys(props)) AS keys FROM events""")
def json_map_array(spark, d):
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, d, "events").select(
        "event_id", F.element_at(m, "k").alias("k"), F.size(F.map_keys(m)).alias("keys"))


@query("features_rows", """WITH j AS (SELECT p.region, p.entity, p.date, p.event_count, s.side_value
    FROM panel p JOIN side s ON p.region = s.region AND p.entity = s.entity AND p.date = s.date),
  w AS (SELECT *, lag(event_count, 1) OVER o AS event_lag_1d, lag(event_count, 3) OVER o AS event_lag_3d,
    lag(event_count, 7) OVER o AS event_lag_7d,
    avg(event_count) OVER (PARTITION BY region, entity ORDER BY date ROWS BETWEEN 3 PRECEDING
      AND 1 PRECEDING) AS event_mean_3d,
    avg(event_count) OVER (PARTITION BY region, entity ORDER BY date ROWS BETWEEN 7 PRECEDING
      AND 1 PRECEDING) AS event_mean_7d, lead(event_count) OVER o AS target_event_count
    FROM j WINDOW o AS (PARTITION BY region, entity ORDER BY date))
  SELECT *, CASE WHEN year(date) < 2000 THEN 'train' ELSE 'test' END AS split,
    (date - make_date(year(date), 10, 1) + 1)::INTEGER AS day_of_season,
    round(sin(2 * pi() * (date - make_date(year(date), 10, 1) + 1) / 61), 9) AS season_sin,
    round(cos(2 * pi() * (date - make_date(year(date), 10, 1) + 1) / 61), 9) AS season_cos,
    (target_event_count > 2)::INTEGER AS target
  FROM w WHERE event_lag_7d IS NOT NULL AND target_event_count IS NOT NULL""")
def features_rows(spark, d):
    f = FT.features_rows(panel(spark, d).select(*DAY_KEYS, "event_count"),
                         side(spark, d).select(*DAY_KEYS, "side_value"))
    return f.withColumns({"season_sin": F.round("season_sin", 9),
                          "season_cos": F.round("season_cos", 9),
                          "split": F.when(F.year("date") < 2000, "train").otherwise("test")})


@query("features_calendar", f"""SELECT p.*, s.side_value, s.side_count, {LEAD_COLS},
  dayofyear(p.date)::INTEGER AS day_of_year,
  round(sin(2 * pi() * dayofyear(p.date) / 365.25), 9) AS sin_year,
  round(cos(2 * pi() * dayofyear(p.date) / 365.25), 9) AS cos_year FROM full_lags p
  JOIN side s ON s.region = p.region AND s.entity = p.entity AND s.date = p.date
  {' '.join(shifted(h, '+') for h in L.DEFAULT_HORIZONS)}
  WHERE {' AND '.join(f'f{h}.event_count IS NOT NULL' for h in L.DEFAULT_HORIZONS)}""")
def features_calendar(spark, d):
    f = FT.features_calendar(panel(spark, d).select(*DAY_KEYS, "event_count", "measure_sum"),
                             side(spark, d).select(*DAY_KEYS, "side_value", "side_count"))
    return f.withColumns({c: F.round(c, 9) for c in ("sin_year", "cos_year")})


define("roll", """SELECT region, entity, date, count(*) FILTER (WHERE event_count > 0) AS active_cell_count,
  max(event_count) AS max_cell_event_count, max(measure_sum) AS max_cell_measure,
  max(event_count) / sum(event_count)::DOUBLE AS max_cell_share
  FROM celldays WHERE month(date) IN (10, 11) GROUP BY ALL""", "celldays")
define("gridbase", """SELECT p.region, p.entity, p.date, p.event_count, p.measure_sum, s.side_value,
  coalesce(active_cell_count, 0) AS active_cell_count,
  coalesce(max_cell_event_count, 0) AS max_cell_event_count,
  coalesce(max_cell_measure, 0) AS max_cell_measure, coalesce(max_cell_share, 0) AS max_cell_share
  FROM panel p LEFT JOIN roll r ON r.region = p.region AND r.entity = p.entity AND r.date = p.date
  LEFT JOIN side s ON s.region = p.region AND s.entity = p.entity AND s.date = p.date""",
       "panel", "roll", "side")
GRID_SRC = {"event_count": "event", "measure_sum": "measure"} | {c: c for c in FT.GRID_COLUMNS}
GRID_LAGS = ", ".join(f"b{k}.{c} AS {s}_lag_{k}d" for k in L.DEFAULT_LAGS for c, s in GRID_SRC.items())


@query("features_grid", f"""WITH g AS (SELECT p.*, {GRID_LAGS}, f1.event_count AS event_count_t_plus_1d,
    f1.measure_sum AS measure_sum_t_plus_1d FROM gridbase p
    {' '.join(shifted(k, src='gridbase') for k in L.DEFAULT_LAGS)} {shifted(1, '+', 'gridbase')})
  SELECT *, {MEANS}, year(date)::INTEGER AS year, month(date)::INTEGER AS month,
    day(date)::INTEGER AS day, (date - make_date(year(date), 10, 1) + 1)::INTEGER AS day_of_season,
    dayofyear(date)::INTEGER AS day_of_year,
    round(sin(2 * pi() * dayofyear(date) / 365.25), 9) AS sin_year,
    round(cos(2 * pi() * dayofyear(date) / 365.25), 9) AS cos_year,
    (event_count_t_plus_1d > 2)::INTEGER AS target_label_t_plus_1d FROM g""")
def features_grid(spark, d):
    from daymosaic.suite.aggregates import cell_days
    from daymosaic.functions.calendar import in_season
    roll = P.cell_rollup(cell_days(spark, d).filter(in_season("date")), DAY_KEYS)
    f = FT.features_grid(panel(spark, d).select(*DAY_KEYS, "event_count", "measure_sum"), roll,
                         side(spark, d).select(*DAY_KEYS, "side_value"))
    return f.withColumns({c: F.round(c, 9) for c in ("sin_year", "cos_year")})
