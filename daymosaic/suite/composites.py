"""Panel builders end to end on the derived places."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymosaic.plans import panels as PL
from daymosaic.suite.base import KEYS, years, define, query, side, table
from daymosaic.suite.spatial import RES, TILE, located, polygons

def shapes(spark, d):
    return polygons(spark, d).select(*KEYS, "rings")


PARTS = """year(k.date)::INTEGER AS year, month(k.date)::INTEGER AS month, day(k.date)::INTEGER AS day,
  (k.date - make_date(year(k.date), 10, 1) + 1)::INTEGER AS day_of_season"""
define("spotobs", """SELECT p.region, p.entity, CAST(l_shipdate AS DATE) AS date, count(*) AS event_count,
  sum(l_quantity) AS measure_sum, avg(l_quantity) AS measure_mean, max(l_quantity) AS measure_max,
  count(*) FILTER (WHERE l_returnflag = 'R') AS high_count, count(*) FILTER (WHERE l_linestatus = 'O') AS day_count,
  count(*) FILTER (WHERE l_linestatus = 'F') AS night_count,
  avg(300 + l_partkey % 60)::DOUBLE AS bright_a_mean, max(300 + l_partkey % 60)::DOUBLE AS bright_a_max,
  avg(280 + l_linenumber)::DOUBLE AS bright_b_mean
  FROM (SELECT *, 69.5::DOUBLE + ((l_partkey * 37 + l_orderkey * 11) % 1100) / 100.0::DOUBLE + 0.0037::DOUBLE AS lon,
    19.5::DOUBLE + ((l_orderkey * 13 + l_linenumber * 101 + l_partkey * 7) % 1100) / 100.0::DOUBLE
      + 0.0037::DOUBLE AS lat FROM lineitem) l
  JOIN placed p ON l.lon = p.lon AND l.lat = p.lat WHERE month(l_shipdate) IN (10, 11) GROUP BY ALL""", "placed")


def detailed(spark, d):
    """Located events with the metric columns."""
    line = table(spark, d, "lineitem")
    m = F.col("l_partkey") * 37 + F.col("l_orderkey") * 11
    n = F.col("l_orderkey") * 13 + F.col("l_linenumber") * 101 + F.col("l_partkey") * 7
    return line.select(
        F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("measure"),
        (F.lit(300.0) + F.col("l_partkey") % 60).alias("bright_a"),
        (F.lit(280.0) + F.col("l_linenumber")).alias("bright_b"),
        F.col("l_returnflag").alias("confidence"), F.col("l_linestatus").alias("daynight"),
        (F.lit(69.5) + (m % 1100) / F.lit(100.0) + F.lit(0.0037)).alias("lon"),
        (F.lit(19.5) + (n % 1100) / F.lit(100.0) + F.lit(0.0037)).alias("lat"))


@query("count_panel", f"""SELECT k.region, k.entity, k.date, coalesce(event_count, 0) AS event_count, {PARTS}
  FROM skel k LEFT JOIN spotobs o ON o.region = k.region AND o.entity = k.entity AND o.date = k.date""")
def count_panel(spark, d):
    return PL.count_panel(located(spark, d), shapes(spark, d), years(spark, d), TILE)


METRIC = ", ".join(f"coalesce({c}, 0) AS {c}" for c in (
    "event_count", "measure_sum", "measure_mean", "measure_max", "high_count", "day_count", "night_count",
    "bright_a_mean", "bright_a_max", "bright_b_mean"))


@query("metric_panel", f"""SELECT k.region, k.entity, k.date, {METRIC}, {PARTS} FROM skel k
  LEFT JOIN spotobs o ON o.region = k.region AND o.entity = k.entity AND o.date = k.date""")
def metric_panel(spark, d):
    return PL.metric_panel(detailed(spark, d), shapes(spark, d), years(spark, d), TILE,
                           F.col("confidence") == "R", F.col("daynight") == "O", F.col("daynight") == "F")


def built(spark, d, resolution=RES):
    return PL.grid_panel(located(spark, d), shapes(spark, d), years(spark, d), resolution, TILE)


@query("grid_panel_cells", f"""SELECT k.region, k.grid_x, k.grid_y, k.cell_id, k.entity, k.date, k.event_count,
  k.measure_sum, {PARTS}, 0.5::DOUBLE AS resolution_degrees FROM half_grid k""")
def grid_panel_cells(spark, d):
    return built(spark, d).grid


define("half_entity", """SELECT k.region, k.entity, k.date, coalesce(sum(g.event_count), 0)::BIGINT AS event_count,
  coalesce(sum(g.measure_sum), 0.0) AS measure_sum FROM skel k LEFT JOIN half_grid g
  ON g.region = k.region AND g.entity = k.entity AND g.date = k.date GROUP BY ALL""", "half_grid", "skel")


@query("grid_panel_entities", f"SELECT k.*, {PARTS} FROM half_entity k")
def grid_panel_entities(spark, d):
    return built(spark, d).entity


@query("grid_panel_weighted", """SELECT k.region, k.entity, k.date,
    round(coalesce(w.event_count_weighted, 0.0), 6) AS event_count_weighted FROM skel k LEFT JOIN (
      SELECT w.region, w.entity, x.date, sum(x.event_count * w.area_weight) AS event_count_weighted
      FROM half_days x JOIN half_weights w ON w.region = x.region AND w.grid_x = x.grid_x AND w.grid_y = x.grid_y
      GROUP BY ALL) w ON w.region = k.region AND w.entity = k.entity AND w.date = k.date""")
def grid_panel_weighted(spark, d):
    out = built(spark, d).weighted
    return out.withColumn("event_count_weighted", F.round("event_count_weighted", 6))


@query("grid_panel_conservation", """WITH t AS (SELECT sum(event_count) AS base FROM half_days)
  SELECT 'grid' AS name, abs(sum(event_count) - (SELECT base FROM t)) <= 1e-6 AS passed FROM half_grid
  UNION ALL SELECT 'entity', abs(sum(event_count) - (SELECT base FROM t)) <= 1e-6 FROM half_entity
  UNION ALL SELECT 'weighted', abs(sum(x.event_count * w.area_weight) - (SELECT base FROM t)) <= 1e-6
    FROM half_days x JOIN half_weights w ON w.region = x.region AND w.grid_x = x.grid_x AND w.grid_y = x.grid_y""")
def grid_panel_conservation(spark, d):
    return built(spark, d).checks.select("name", "passed")


@query("cell_mapping_check", """SELECT 'same_cells' AS name, count(*) = 0 AS passed, CAST(count(*) AS VARCHAR) AS detail
  FROM (SELECT cell_id FROM half_assigned) a FULL JOIN (SELECT DISTINCT cell_id FROM half_grid) g
  ON a.cell_id = g.cell_id WHERE a.cell_id IS NULL OR g.cell_id IS NULL""")
def cell_mapping_check(spark, d):
    b = built(spark, d)
    return PL.mapping_matches_panel(b.mapping, b.grid)


@query("enrich_grid", """SELECT g.region, g.entity, g.cell_id, g.date, g.event_count, s.side_value, s.side_count,
  s.side_count IS NOT NULL AS side_matched FROM half_grid g LEFT JOIN side s ON s.region = g.region
  AND s.entity = g.entity AND s.date = g.date""")
def enrich_grid(spark, d):
    out = PL.enrich_grid(built(spark, d).grid, side(spark, d), ["side_value", "side_count"])
    return out.select("region", "entity", "cell_id", "date", "event_count", "side_value", "side_count",
                      "side_matched")


@query("enrich_report", """SELECT count(*) AS rows, count(s.side_value) AS matched,
  sum(event_count)::BIGINT AS events, sum(event_count) = (SELECT sum(event_count) FROM half_grid) AS events_preserved
  FROM half_grid g LEFT JOIN side s ON s.region = g.region AND s.entity = g.entity AND s.date = g.date""")
def enrich_report(spark, d):
    g = built(spark, d).grid
    return PL.enrich_report(g, PL.enrich_grid(g, side(spark, d), ["side_value"]))
