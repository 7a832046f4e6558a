"""Spatial joins, grids and cell assignment on derived places."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymosaic.functions import geo
from daymosaic.functions.calendar import in_season, season_dates
from daymosaic.operators import neighbours as NB
from daymosaic.operators import spatial as S
from daymosaic.session import materialise
from daymosaic.sources import polygons as PG
from daymosaic.suite.base import KEYS, years, define, entities, query, table

TILE = 0.5
RES, COARSE = 0.5, 1.0

SHAPE = [(0.0, 0.0), (2.0, 0.0), (2.3, 1.0), (2.0, 2.0), (0.0, 2.0), (0.3, 1.0), (0.0, 0.0)]
HOLE = [(0.8, 0.7), (0.8, 1.3), (1.4, 1.3), (1.4, 0.7), (0.8, 0.7)]


def polygons(spark, d):
    """25 concave shapes in rows by region; every seventh has a hole."""
    e = entities(spark, d)
    x0 = F.floor(F.col("n_nationkey") / 5) * 2 + F.lit(70.0)
    y0 = (F.col("n_nationkey") % 5) * 2 + F.lit(20.0)
    ring = lambda pts: F.array(*[F.struct((x0 + F.lit(a)).alias("x"), (y0 + F.lit(b)).alias("y"))
                                 for a, b in pts])
    rings = F.when(F.col("n_nationkey") % 7 == 3, F.array(ring(SHAPE), ring(HOLE))).otherwise(
        F.array(ring(SHAPE)))
    return e.select(*KEYS, F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("code"),
                    F.lit("Polygon").alias("geometry_type"), rings.alias("rings"))


def located(spark, d):
    """Every lineitem at an arithmetic place; some fall outside all polygons."""
    line = table(spark, d, "lineitem")
    m = F.col("l_partkey") * 37 + F.col("l_orderkey") * 11
    n = F.col("l_orderkey") * 13 + F.col("l_linenumber") * 101 + F.col("l_partkey") * 7
    return line.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("measure"),
        (F.lit(69.5) + (m % 1100) / F.lit(100.0) + F.lit(0.0037)).alias("lon"),
        (F.lit(19.5) + (n % 1100) / F.lit(100.0) + F.lit(0.0037)).alias("lat"))


def seg_sql(pts, ring: int) -> str:
    return ", ".join(f"({ring}, {i}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)"
                     for i, (a, b) in enumerate(zip(pts, pts[1:])))


define("polyedge", f"""SELECT region, entity, n_nationkey, ring_no, edge_no,
    70::DOUBLE + 2 * (n_nationkey // 5) + px AS x1, 20::DOUBLE + 2 * (n_nationkey % 5) + py AS y1,
    70::DOUBLE + 2 * (n_nationkey // 5) + qx AS x2, 20::DOUBLE + 2 * (n_nationkey % 5) + qy AS y2
  FROM ent, (VALUES {seg_sql(SHAPE, 0)}, {seg_sql(HOLE, 1)}) s(ring_no, edge_no, px, py, qx, qy)
  WHERE ring_no = 0 OR n_nationkey % 7 = 3""", "ent")
define("located", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CAST(l_shipdate AS DATE) AS date, l_quantity AS measure,
    69.5::DOUBLE + ((l_partkey * 37 + l_orderkey * 11) % 1100) / 100.0::DOUBLE + 0.0037::DOUBLE AS lon,
    19.5::DOUBLE + ((l_orderkey * 13 + l_linenumber * 101 + l_partkey * 7) % 1100) / 100.0::DOUBLE
      + 0.0037::DOUBLE AS lat FROM lineitem""")
define("places", """SELECT DISTINCT lon, lat FROM located""", "located")
define("placed", """SELECT p.lon, p.lat, e.region, e.entity FROM places p JOIN polyedge e
    ON (e.y1 > p.lat) <> (e.y2 > p.lat)
      AND p.lon < e.x1 + (p.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
  GROUP BY ALL HAVING count(*) % 2 = 1""", "places", "polyedge")


def placed(spark, d, how="left"):
    return S.point_in_polygon(located(spark, d), polygons(spark, d).select(*KEYS, "rings"), KEYS,
                              TILE, how)


@query("edge_table", "SELECT region, entity, ring_no, edge_no, x1, y1, x2, y2 FROM polyedge")
def edge_table(spark, d):
    return S.edge_table(polygons(spark, d), KEYS)


@query("point_in_polygon", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l.lon, l.lat,
  region, entity FROM located l LEFT JOIN placed p ON l.lon = p.lon AND l.lat = p.lat""")
def point_in_polygon(spark, d):
    return placed(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "lon",
                                   "lat", *KEYS)


@query("point_in_polygon_inner", """SELECT region, entity, count(*) AS n, sum(measure) AS measure
  FROM located l JOIN placed p ON l.lon = p.lon AND l.lat = p.lat GROUP BY region, entity""")
def point_in_polygon_inner(spark, d):
    return placed(spark, d, "inner").groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("measure").alias("measure"))


@query("multi_match", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) AS matches
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, date, l.lon, l.lat, entity
    FROM located l JOIN placed p ON l.lon = p.lon AND l.lat = p.lat)
  GROUP BY ALL HAVING count(*) > 1""")
def multi_match(spark, d):
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = placed(spark, d).select(*key, "date", "lon", "lat", "entity").distinct()
    return S.multi_match(rows, key, "entity")


@query("unmatched_report", """SELECT count(*) AS points, count(entity) AS matched,
  count(*) FILTER (WHERE entity IS NULL) AS unmatched,
  min(l.lon) FILTER (WHERE entity IS NULL) AS lon_min, max(l.lon) FILTER (WHERE entity IS NULL) AS lon_max,
  min(l.lat) FILTER (WHERE entity IS NULL) AS lat_min, max(l.lat) FILTER (WHERE entity IS NULL) AS lat_max
  FROM located l LEFT JOIN placed p ON l.lon = p.lon AND l.lat = p.lat""")
def unmatched_report(spark, d):
    return S.unmatched_report(placed(spark, d), "entity")


@query("unmatched_sample", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l.lon, l.lat FROM located l
  LEFT JOIN placed p ON l.lon = p.lon AND l.lat = p.lat WHERE entity IS NULL
  ORDER BY md5(concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber)), l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 20""")
def unmatched_sample(spark, d):
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return S.unmatched_sample(placed(spark, d), "entity", key).select(*key, "lon", "lat")


@query("interior_points", """WITH m AS (SELECT region, entity, (min(y1) + max(y1)) / 2 AS lat
    FROM polyedge GROUP BY ALL),
  x AS (SELECT m.region, m.entity, lat, x1 + (lat - y1) * (x2 - x1) / (y2 - y1) AS x,
      row_number() OVER (PARTITION BY m.entity ORDER BY x1 + (lat - y1) * (x2 - x1) / (y2 - y1)) AS rn
    FROM m JOIN polyedge e ON e.entity = m.entity AND (y1 > lat) <> (y2 > lat)),
  s AS (SELECT a.region, a.entity, a.lat, b.x - a.x AS w, (b.x + a.x) / 2 AS mid FROM x a JOIN x b
    ON a.entity = b.entity AND b.rn = a.rn + 1 AND a.rn % 2 = 1)
  SELECT region, entity, max_by(mid, (w, mid)) AS lon, max(lat) AS lat FROM s GROUP BY region, entity""")
def interior_points(spark, d):
    return S.interior_points(polygons(spark, d), KEYS)


@query("adjacency", """WITH v AS (SELECT DISTINCT region, entity, x1 AS px, y1 AS py FROM polyedge),
  t AS (SELECT DISTINCT v.region AS ra, v.entity AS a, e.region AS rb, e.entity AS b FROM v JOIN polyedge e
    ON (v.region <> e.region OR v.entity <> e.entity)
    AND px BETWEEN least(x1, x2) - 1e-9 AND greatest(x1, x2) + 1e-9
    AND py BETWEEN least(y1, y2) - 1e-9 AND greatest(y1, y2) + 1e-9
    AND abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) <= 1e-9)
  SELECT ra AS region, a AS entity, rb AS neighbor_region, b AS neighbor FROM t UNION SELECT rb, b, ra, a FROM t""")
def adjacency(spark, d):
    return S.adjacency(polygons(spark, d), KEYS, TILE)


@query("asymmetric_pairs", """SELECT a.region, a.entity, b.region AS neighbor_region, b.entity AS neighbor FROM ent a JOIN ent b
  ON b.n_nationkey = a.n_nationkey + 1""")
def asymmetric_pairs(spark, d):
    e = entities(spark, d)
    nxt = e.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("region").alias("neighbor_region"),
                   F.col("entity").alias("neighbor"))
    return S.asymmetric_pairs(e.join(nxt, "n_nationkey").drop("n_nationkey"), KEYS)


def my_sql(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return (f"({geo.Y_SCALE!r}::DOUBLE * {1 - geo.E2!r}::DOUBLE * ({s} / (1 - {geo.E2!r}::DOUBLE * {s} * {s})"
            f" - ln((1 - {geo.E1!r}::DOUBLE * {s}) / (1 + {geo.E1!r}::DOUBLE * {s})) / {2 * geo.E1!r}::DOUBLE))")


def define_overlaps(name: str, r: float) -> None:
    define(f"{name}_cells", f"""SELECT b.region, b.entity, gx, gy, gx * {r}::DOUBLE * {geo.X_SCALE!r}::DOUBLE AS cx0,
      (gx + 1) * {r}::DOUBLE * {geo.X_SCALE!r}::DOUBLE AS cx1, {my_sql(f'gy * {r}::DOUBLE')} AS cy0,
      {my_sql(f'(gy + 1) * {r}::DOUBLE')} AS cy1
      FROM (SELECT region, entity, min(x1) AS x0, max(x1) AS xx, min(y1) AS y0, max(y1) AS yy
        FROM polyedge GROUP BY region, entity) b,
        range({int(69 / r)}, {int(82 / r)}) g(gx), range({int(19 / r)}, {int(31 / r)}) h(gy)
      WHERE gx BETWEEN floor(x0 / {r}) AND floor(xx / {r}) AND gy BETWEEN floor(y0 / {r}) AND floor(yy / {r})""",
           "polyedge")
    define(f"{name}_parts", f"""SELECT c.region, c.entity, gx, gy, cx0, cx1, cy0, cy1,
      x1 * {geo.X_SCALE!r}::DOUBLE AS px1, x2 * {geo.X_SCALE!r}::DOUBLE AS px2,
      {my_sql('y1')} AS py1, {my_sql('y2')} AS py2
      FROM {name}_cells c JOIN polyedge e ON e.entity = c.entity AND x1 <> x2""",
           f"{name}_cells", "polyedge")
    define(f"{name}_cut", f"""SELECT *, py1 + (a - px1) * (py2 - py1) / (px2 - px1) AS ya,
      py1 + (b - px1) * (py2 - py1) / (px2 - px1) AS yb FROM (SELECT *,
      greatest(least(px1, px2), cx0) AS a, least(greatest(px1, px2), cx1) AS b FROM {name}_parts)
      WHERE b > a""", f"{name}_parts")
    define(f"{name}_over", f"""SELECT region, entity, gx AS grid_x, gy AS grid_y, abs(sum(sign(px2 - px1) * (b - a) *
      CASE WHEN ya = yb THEN least(greatest(ya, cy0), cy1) - cy0 ELSE
        (greatest(0, greatest(ya, yb) - greatest(least(ya, yb), cy1)) * (cy1 - cy0)
        + (least(greatest(greatest(ya, yb), cy0), cy1) - least(greatest(least(ya, yb), cy0), cy1))
        * ((least(greatest(greatest(ya, yb), cy0), cy1) + least(greatest(least(ya, yb), cy0), cy1)) / 2 - cy0))
        / abs(yb - ya) END)) AS area_m2
      FROM {name}_cut GROUP BY ALL HAVING area_m2 > 1""", f"{name}_cut")
    define(f"{name}_weights", f"""SELECT *, region || '|' || grid_x || '|' || grid_y AS cell_id,
      area_m2 / sum(area_m2) OVER (PARTITION BY region, grid_x, grid_y) AS area_weight
      FROM {name}_over""", f"{name}_over")
    mid = f"(({my_sql(f'grid_y * {r}::DOUBLE')} + {my_sql(f'(grid_y + 1) * {r}::DOUBLE')}) / 2)"
    beta = f"asin({mid} / {geo.Y_SCALE!r}::DOUBLE / {geo.Q_POLE!r}::DOUBLE)"
    define(f"{name}_centres", f"""SELECT DISTINCT region, grid_x, grid_y, cell_id,
      (grid_x * {r}::DOUBLE + (grid_x + 1) * {r}::DOUBLE) / 2 AS lon,
      degrees({beta} + {geo.A2!r}::DOUBLE * sin(2 * {beta}) + {geo.A4!r}::DOUBLE * sin(4 * {beta})
        + {geo.A6!r}::DOUBLE * sin(6 * {beta})) AS lat FROM {name}_weights""", f"{name}_weights")
    define(f"{name}_held", f"""SELECT c.region, c.grid_x, c.grid_y, e.entity FROM {name}_centres c
      JOIN polyedge e ON e.region = c.region AND (y1 > lat) <> (y2 > lat)
        AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
      GROUP BY ALL HAVING count(*) % 2 = 1""", f"{name}_centres", "polyedge")
    define(f"{name}_assigned", f"""SELECT c.region, c.grid_x, c.grid_y, c.cell_id,
      coalesce(h.entity, l.entity) AS entity, CASE WHEN h.entity IS NULL
        THEN 'largest_overlap_fallback' ELSE 'centroid' END AS assignment_method,
      n.n AS overlap_entity_count FROM {name}_centres c
      LEFT JOIN (SELECT region, grid_x, grid_y, min(entity) AS entity FROM {name}_held GROUP BY ALL) h
        ON h.region = c.region AND h.grid_x = c.grid_x AND h.grid_y = c.grid_y
      JOIN (SELECT region, grid_x, grid_y, min(entity) AS entity FROM (SELECT *, max(area_m2) OVER
        (PARTITION BY region, grid_x, grid_y) AS m FROM {name}_over) WHERE m - area_m2 <= 1 GROUP BY ALL) l
        ON l.region = c.region AND l.grid_x = c.grid_x AND l.grid_y = c.grid_y
      JOIN (SELECT region, grid_x, grid_y, count(*) AS n FROM {name}_over GROUP BY ALL) n
        ON n.region = c.region AND n.grid_x = c.grid_x AND n.grid_y = c.grid_y""",
           f"{name}_centres", f"{name}_held", f"{name}_over")


define_overlaps("half", RES)
define_overlaps("whole", COARSE)


def overlaps(spark, d, resolution=RES):
    return S.cell_overlaps(polygons(spark, d).select(*KEYS, "rings"), KEYS, resolution)


@query("cell_overlaps", """SELECT region, entity, grid_x, grid_y, cell_id, round(area_m2, 1) AS area_m2,
  round(area_weight, 9) AS area_weight FROM half_weights""")
def cell_overlaps(spark, d):
    return S.overlap_weights(overlaps(spark, d)).select(
        *KEYS, "grid_x", "grid_y", "cell_id", F.round("area_m2", 1).alias("area_m2"),
        F.round("area_weight", 9).alias("area_weight"))


@query("cell_overlaps_coarse", """SELECT region, entity, grid_x, grid_y, round(area_m2, 1) AS area_m2,
  round(area_weight, 9) AS area_weight FROM whole_weights""")
def cell_overlaps_coarse(spark, d):
    return S.overlap_weights(overlaps(spark, d, COARSE)).select(
        *KEYS, "grid_x", "grid_y", F.round("area_m2", 1).alias("area_m2"),
        F.round("area_weight", 9).alias("area_weight"))


@query("eligible_cells", "SELECT DISTINCT region, grid_x, grid_y, cell_id FROM half_weights")
def eligible_cells(spark, d):
    return S.eligible_cells(overlaps(spark, d))


@query("assign_cells", "SELECT * FROM half_assigned")
def assign_cells(spark, d):
    shapes = polygons(spark, d).select(*KEYS, "rings")
    return S.assign_cells(overlaps(spark, d), shapes, RES, TILE)


@query("cell_mapping_coarse", "SELECT * FROM whole_assigned")
def cell_mapping_coarse(spark, d):
    shapes = polygons(spark, d).select(*KEYS, "rings")
    return S.assign_cells(overlaps(spark, d, COARSE), shapes, COARSE, TILE)


@query("grid_index", """SELECT CAST(floor(lon / 0.05::DOUBLE) AS BIGINT) AS grid_x,
  CAST(floor(lat / 0.05::DOUBLE) AS BIGINT) AS grid_y, count(*) AS n FROM located GROUP BY ALL""")
def grid_index(spark, d):
    return located(spark, d).groupBy(
        geo.grid_index(F.col("lon"), 0.05).alias("grid_x"),
        geo.grid_index(F.col("lat"), 0.05).alias("grid_y")).agg(F.count(F.lit(1)).alias("n"))


@query("cell_box_centroid", f"""SELECT grid_x, grid_y, grid_x * 0.5::DOUBLE AS x0, grid_y * 0.5::DOUBLE AS y0,
  (grid_x + 1) * 0.5::DOUBLE AS x1, (grid_y + 1) * 0.5::DOUBLE AS y1, lon, round(lat, 9) AS lat
  FROM half_centres""")
def cell_box_centroid(spark, d):
    cells = S.eligible_cells(overlaps(spark, d))
    box = geo.cell_box(F.col("grid_x"), F.col("grid_y"), RES)
    lon, lat = geo.cell_centroid(F.col("grid_x"), F.col("grid_y"), RES)
    return cells.select("grid_x", "grid_y", *[c.alias(n) for n, c in box.items()],
                        lon.alias("lon"), F.round(lat, 9).alias("lat"))


@query("equal_area_projection", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(lon * {geo.X_SCALE!r}::DOUBLE, 3) AS x, round({my_sql('lat')}, 3) AS y FROM located""")
def equal_area_projection(spark, d):
    return located(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                    F.round(geo.metric_x(F.col("lon")), 3).alias("x"),
                                    F.round(geo.metric_y(F.col("lat")), 3).alias("y"))


for _n, _r in (("half", RES), ("whole", COARSE)):
    define(f"{_n}_days", f"""SELECT p.region, CAST(floor(l.lon / {_r}) AS BIGINT) AS grid_x,
      CAST(floor(l.lat / {_r}) AS BIGINT) AS grid_y, l.date, count(*) AS event_count,
      sum(measure) AS measure_sum FROM located l JOIN placed p ON l.lon = p.lon AND l.lat = p.lat
      WHERE month(date) IN (10, 11) GROUP BY ALL""", "located", "placed")
    define(f"{_n}_grid", f"""SELECT c.region, c.grid_x, c.grid_y, c.cell_id, c.entity, k.date,
      coalesce(x.event_count, 0) AS event_count, coalesce(x.measure_sum, 0.0) AS measure_sum
      FROM {_n}_assigned c CROSS JOIN cal k LEFT JOIN {_n}_days x ON x.region = c.region
        AND x.grid_x = c.grid_x AND x.grid_y = c.grid_y AND x.date = k.date""",
           f"{_n}_assigned", f"{_n}_days", "cal")
    define(f"{_n}_deg", f"""SELECT a.region, a.grid_x, a.grid_y, a.cell_id, a.entity, count(b.cell_id)
      AS physical_neighbor_count FROM {_n}_assigned a LEFT JOIN {_n}_assigned b ON a.region = b.region
        AND abs(a.grid_x - b.grid_x) <= 1 AND abs(a.grid_y - b.grid_y) <= 1
        AND a.cell_id <> b.cell_id GROUP BY ALL""", f"{_n}_assigned")
    define(f"{_n}_around", f"""SELECT t.region, t.grid_x, t.grid_y, s.date + 1 AS date,
      sum(s.event_count)::BIGINT AS ev_sum, sum(s.measure_sum) AS me_sum, count(*) AS act, max(s.event_count) AS mx
      FROM {_n}_days s JOIN {_n}_assigned t ON t.region = s.region AND abs(t.grid_x - s.grid_x) <= 1
        AND abs(t.grid_y - s.grid_y) <= 1 AND NOT (t.grid_x = s.grid_x AND t.grid_y = s.grid_y)
      GROUP BY ALL""", f"{_n}_days", f"{_n}_assigned")
    define(f"{_n}_moore", f"""SELECT d.region, d.grid_x, d.grid_y, d.cell_id, d.entity, k.date,
      d.physical_neighbor_count, CASE WHEN ok THEN d.physical_neighbor_count ELSE 0 END
        AS neighbor_observed_count,
      CASE WHEN ok THEN coalesce(ev_sum, 0) END AS neighbor_event_count,
      CASE WHEN ok THEN coalesce(me_sum, 0.0) END AS neighbor_measure_sum,
      CASE WHEN ok THEN coalesce(act, 0) END AS neighbor_active_count,
      CASE WHEN ok THEN coalesce(mx, 0) END AS neighbor_max_event_count,
      CASE WHEN ok THEN coalesce(ev_sum, 0) / nullif(d.physical_neighbor_count, 0)::DOUBLE END
        AS neighbor_event_mean,
      CASE WHEN ok THEN coalesce(me_sum, 0.0) / nullif(d.physical_neighbor_count, 0)::DOUBLE END
        AS neighbor_measure_mean,
      CASE WHEN ok AND d.physical_neighbor_count > 0 THEN 1.0::DOUBLE END AS neighbor_coverage
      FROM {_n}_deg d CROSS JOIN (SELECT date, NOT (month(date) = 10 AND day(date) = 1) AS ok FROM cal) k
      LEFT JOIN {_n}_around a ON a.region = d.region AND a.grid_x = d.grid_x AND a.grid_y = d.grid_y
        AND a.date = k.date""", f"{_n}_deg", f"{_n}_around", "cal")


def cell_counts(spark, d, resolution):
    rows = placed(spark, d, "inner").filter(in_season("date", years(spark, d)))
    return NB.with_grid(rows, resolution).groupBy("region", "grid_x", "grid_y", "date").agg(
        F.count(F.lit(1)).alias("event_count"), F.sum("measure").alias("measure_sum"))


def mapping(spark, d, resolution):
    """Cells and their entities: reference-sized, written once and read by each branch."""
    shapes = polygons(spark, d).select(*KEYS, "rings")
    over = S.cell_overlaps(shapes, KEYS, resolution)
    return materialise(S.assign_cells(over, shapes, resolution, TILE), "cell-mapping")


@query("neighbour_degree", """SELECT region, grid_x, grid_y, cell_id, entity, physical_neighbor_count
  FROM half_deg""")
def neighbour_degree(spark, d):
    cells = mapping(spark, d, RES).select("region", "grid_x", "grid_y", "cell_id", "entity")
    return NB.neighbour_degree(cells)


def moore(spark, d, resolution):
    cells = mapping(spark, d, resolution).select("region", "grid_x", "grid_y", "cell_id", "entity")
    return NB.moore_neighbours(cell_counts(spark, d, resolution), cells, season_dates(years(spark, d)),
                               in_season("previous_date", years(spark, d)))


@query("moore_neighbours", "SELECT * FROM half_moore")
def moore_neighbours(spark, d):
    return moore(spark, d, RES)


ROLL = """SELECT region, entity, date, avg(neighbor_event_count) AS neighbor_event_count_lag_1d_mean,
  max(neighbor_event_count) AS neighbor_event_count_lag_1d_max,
  round(avg(neighbor_event_mean), 9) AS neighbor_event_per_neighbor_mean,
  avg(neighbor_measure_sum) AS neighbor_measure_sum_lag_1d_mean,
  round(avg(neighbor_measure_mean), 9) AS neighbor_measure_per_neighbor_mean,
  avg(neighbor_active_count) AS neighbor_active_cells_lag_1d_mean,
  max(neighbor_max_event_count) AS neighbor_max_event_count_lag_1d_max,
  avg(neighbor_coverage) AS neighbor_coverage_mean FROM {n}_moore GROUP BY region, entity, date"""


def roll(spark, d, resolution):
    out = NB.neighbour_rollup(moore(spark, d, resolution), ["region", "entity", "date"])
    return out.withColumns({c: F.round(c, 9) for c in ("neighbor_event_per_neighbor_mean",
                                                       "neighbor_measure_per_neighbor_mean")})


@query("features_grid_neighbour", ROLL.format(n="half"))
def features_grid_neighbour(spark, d):
    return roll(spark, d, RES)


@query("features_grid_neighbour_coarse", ROLL.format(n="whole"))
def features_grid_neighbour_coarse(spark, d):
    return roll(spark, d, COARSE)


define("ringstat", """SELECT region, entity, n_nationkey, ring_no, count(*) + 1 AS points,
    sum(x1 * y2 - x2 * y1) AS area2, max_by(x2, edge_no) = min_by(x1, edge_no)
      AND max_by(y2, edge_no) = min_by(y1, edge_no) AS closed FROM polyedge GROUP BY ALL""", "polyedge")


@query("boundary_audit", """SELECT 'Polygon' AS geometry_type, count(DISTINCT entity) AS features,
  0::BIGINT AS missing, 0::BIGINT AS empty, count(DISTINCT entity) FILTER (WHERE points < 4) AS short_ring,
  count(DISTINCT entity) FILTER (WHERE NOT closed) AS open_ring,
  count(DISTINCT entity) FILTER (WHERE area2 = 0) AS zero_area, count(DISTINCT region) AS regions,
  count(DISTINCT entity) AS entities, count(DISTINCT n_nationkey) AS codes FROM ringstat""")
def boundary_audit(spark, d):
    return PG.boundary_audit(polygons(spark, d))


@query("polygon_checks", """WITH c AS (SELECT count(DISTINCT (region, entity)) AS n,
    count(*) FILTER (WHERE region IS NULL OR entity IS NULL) AS k,
    count(DISTINCT n_nationkey) - count(DISTINCT (region, entity)) AS u, count(*) FILTER (WHERE points < 4) AS s,
    count(*) FILTER (WHERE NOT closed) AS o, count(*) FILTER (WHERE area2 = 0) AS z FROM ringstat)
  SELECT name, CASE name WHEN 'expected_count' THEN v = 25 ELSE v = 0 END AS passed, CAST(v AS VARCHAR) AS detail FROM (
    SELECT 'keys_present' AS name, k AS v FROM c UNION ALL SELECT 'keys_unique', u FROM c
    UNION ALL SELECT 'no_missing', 0 UNION ALL SELECT 'no_empty', 0 UNION ALL SELECT 'no_short_ring', s FROM c
    UNION ALL SELECT 'no_open_ring', o FROM c UNION ALL SELECT 'no_zero_area', z FROM c
    UNION ALL SELECT 'expected_count', n FROM c)""")
def polygon_checks(spark, d):
    return PG.polygon_checks(polygons(spark, d), expected=25)
