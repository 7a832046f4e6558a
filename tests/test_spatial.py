"""Polygons, overlaps, cell assignment, neighbours."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from daymosaic.functions import geo
from daymosaic.functions.calendar import in_season, season_dates
from daymosaic.operators import neighbours as NB
from daymosaic.operators import quality as Q
from daymosaic.operators import spatial as S
from daymosaic.sources import polygons as PG

DDL = "region string, entity string, rings array<array<struct<x:double,y:double>>>"
KEYS = ["region", "entity"]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


CONCAVE = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0), (0.0, 0.0)]
RING = box(4.0, 0.0, 8.0, 4.0)
HOLE = list(reversed(box(5.0, 1.0, 7.0, 3.0)))


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame([("r", "concave", [CONCAVE]), ("r", "ring", [RING, HOLE])], DDL)


def inside(x, y, rings):
    hit = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                hit = not hit
    return hit


@pytest.mark.parametrize("tile", [0.3, 1.0, 5.0])
def test_points_against_brute_force(spark, shapes, tile):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-1, 9), rnd.uniform(-1, 5)) for i in range(600)]
    pts += [(1000 + i, x, y) for i, (x, y) in enumerate([(4.0, 1.5), (6.0, 2.0), (2.0, 1.0), (0.0, 0.0), (4.5, 0.5)])]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = rows(S.point_in_polygon(df, shapes, KEYS, tile), "id", "entity")
    want = []
    for i, x, y in pts:
        hits = [n for n, r in (("concave", [CONCAVE]), ("ring", [RING, HOLE])) if inside(x, y, r)]
        assert len(hits) <= 1
        want.append((i, hits[0] if hits else None))
    assert got == sorted(want, key=lambda t: [(x is None, str(x)) for x in t])


def test_left_keeps_and_inner_drops(spark, shapes):
    df = spark.createDataFrame([(1, 1.0, 0.5), (2, 6.0, 2.0), (3, 50.0, 50.0)], "id long, lon double, lat double")
    left = S.point_in_polygon(df, shapes, KEYS, 1.0)
    assert rows(left, "id", "entity") == [(1, "concave"), (2, None), (3, None)]
    assert rows(S.point_in_polygon(df, shapes, KEYS, 1.0, "inner"), "id") == [(1,)]
    r = S.unmatched_report(left, "entity").first()
    assert (r["points"], r["matched"], r["unmatched"], r["lon_max"]) == (3, 1, 2, 50.0)


def polygon_area(rings):
    """Area in the metric plane by the shoelace rule."""
    import math
    def y(lat):
        s = math.sin(math.radians(lat))
        return geo.Y_SCALE * geo._q_number(s)
    return abs(sum((x2 - x1) * geo.X_SCALE * (y(y1) + y(y2)) / 2 for ring in rings
                   for (x1, y1), (x2, y2) in zip(ring, ring[1:])))


@pytest.mark.parametrize("resolution", [0.25, 1.0, 3.0])
def test_cell_areas_add_up_to_the_polygon(spark, shapes, resolution):
    got = dict(rows(S.cell_overlaps(shapes, KEYS, resolution).groupBy("entity").agg(F.sum("area_m2"))))
    assert got["concave"] == pytest.approx(polygon_area([CONCAVE]), rel=1e-9)
    assert got["ring"] == pytest.approx(polygon_area([RING, HOLE]), rel=1e-9)


def test_weights_sum_to_one_and_holes_have_no_cells(spark, shapes):
    over = S.overlap_weights(S.cell_overlaps(shapes, KEYS, 0.5))
    assert rows(Q.weights_sum_to_one(over, ["region", "grid_x", "grid_y"]), "passed") == [(True,)]
    assert over.filter("entity = 'ring' and grid_x = 11 and grid_y = 3").count() == 0


def test_cell_ties_and_fallback(spark):
    """Centre on no polygon falls back to the largest overlap; equal overlaps go by name."""
    shapes = spark.createDataFrame([
        ("r", "b", [box(0.0, 0.0, 0.4, 1.0)]), ("r", "a", [box(0.6, 0.0, 1.0, 1.0)]),
        ("r", "d", [box(1.0, 0.0, 1.4, 1.0)]), ("r", "c", [box(1.7, 0.0, 2.0, 1.0)]),
        ("s", "e", [box(0.0, 0.0, 1.0, 1.0)])], DDL)
    over = S.cell_overlaps(shapes, KEYS, 1.0)
    got = rows(S.assign_cells(over, shapes, 1.0, 0.5), "cell_id", "entity", "assignment_method", "overlap_entity_count")
    assert got == [("r|0|0", "a", "largest_overlap_fallback", 2), ("r|1|0", "d", "largest_overlap_fallback", 2),
                   ("s|0|0", "e", "centroid", 1)]


def test_interior_point_is_inside(spark, shapes):
    for r in S.interior_points(shapes, KEYS).collect():
        assert inside(r["lon"], r["lat"], [CONCAVE] if r["entity"] == "concave" else [RING, HOLE])


def test_adjacency_shares_edges_corners_and_t_junctions(spark):
    shapes = spark.createDataFrame([
        ("r", "left", [box(0.0, 0.0, 1.0, 2.0)]), ("r", "low", [box(1.0, 0.0, 2.0, 0.7)]),
        ("r", "corner", [box(2.0, 0.7, 3.0, 2.0)]), ("r", "far", [box(9.0, 9.0, 10.0, 10.0)])], DDL)
    got = rows(S.adjacency(shapes, KEYS, 0.5), "entity", "neighbor")
    assert got == [("corner", "low"), ("left", "low"), ("low", "corner"), ("low", "left")]
    assert S.asymmetric_pairs(S.adjacency(shapes, KEYS, 0.5), KEYS).count() == 0


def test_projection_round_trip(spark):
    """The inverse series is good to a few millimetres."""
    df = spark.createDataFrame([(float(x),) for x in (-60, -10, 0, 25, 31.5, 75)], "lat double")
    for r in df.select("lat", geo.latitude_of(geo.metric_y(F.col("lat"))).alias("back")).collect():
        assert r["back"] == pytest.approx(r["lat"], abs=5e-8)


def test_moore_neighbours_by_hand(spark):
    """3 x 3 cells with a missing corner, a lone cell in another region, the first season day."""
    cells = [("r", x, y) for x in range(3) for y in range(3) if (x, y) != (2, 2)] + [("s", 0, 0)]
    c = spark.createDataFrame([(r, x, y, f"{r}|{x}|{y}") for r, x, y in cells],
                              "region string, grid_x long, grid_y long, cell_id string")
    days = spark.createDataFrame([("r", 0, 0, dt.date(2024, 10, 1), 5, 50.0), ("r", 1, 1, dt.date(2024, 10, 1), 2, 8.0),
                                  ("s", 0, 0, dt.date(2024, 10, 1), 9, 9.0)],
                                 "region string, grid_x long, grid_y long, date date, event_count long, measure_sum double")
    out = NB.moore_neighbours(days, c, season_dates([2024]), in_season("previous_date", [2024]))
    got = {(r["cell_id"], r["date"]): r for r in out.collect()}
    first, second = dt.date(2024, 10, 1), dt.date(2024, 10, 2)
    assert got["r|1|0", first]["neighbor_event_count"] is None and got["r|1|0", first]["neighbor_observed_count"] == 0
    r = got["r|1|0", second]
    assert (r["physical_neighbor_count"], r["neighbor_event_count"], r["neighbor_active_count"],
            r["neighbor_max_event_count"], r["neighbor_event_mean"]) == (5, 7, 2, 5, 7 / 5)
    assert got["r|1|1", second]["neighbor_event_count"] == 5 and got["r|1|1", second]["physical_neighbor_count"] == 7
    lone = got["s|0|0", second]
    assert (lone["neighbor_event_count"], lone["neighbor_event_mean"], lone["neighbor_coverage"]) == (0, None, None)


def test_neighbour_lag_is_the_neighbours_past(spark):
    p = spark.createDataFrame([(r, e, dt.date(2024, 1, d), k * n * d, float(n)) for r, k in (("r", 1), ("s", 7))
                               for e, n in (("a", 1), ("b", 10), ("c", 100)) for d in (1, 2)],
                              "region string, entity string, date date, event_count long, measure_sum double")
    edges = spark.createDataFrame([(r, a, r, b) for r in "rs" for a in "abc" for b in "abc" if a != b],
                                  "region string, entity string, neighbor_region string, neighbor string")
    names = {"event_count": "event"}
    near = NB.neighbour_context(p, edges, names, (1,)).filter("region = 'r' and entity = 'a' and date = '2024-01-02'").first()
    own = NB.neighbour_context(p, edges, names, (1,), own_history=True).filter("region = 'r' and entity = 'a' and date = '2024-01-02'").first()
    assert (near["neighbor_event_current"], near["neighbor_event_lag_1d"], own["neighbor_event_lag_1d"]) == (110, 55, 1)


def test_geojson_reader_orients_and_finds_columns(spark, tmp_path):
    path = tmp_path / "b.geojson"
    path.write_text("""{"type":"FeatureCollection","features":[
      {"type":"Feature","properties":{"STATE_UT":" North ","DISTRICT":"A","DIST_LGD":"1"},
       "geometry":{"type":"Polygon","coordinates":[[[0,0],[0,2],[2,2],[2,0],[0,0]],[[0.5,0.5],[1,0.5],[1,1],[0.5,0.5]]]}},
      {"type":"Feature","properties":{"state":"North","district":"B","code":"1"},
       "geometry":{"type":"MultiPolygon","coordinates":[[[[3,0],[4,0],[4,1],[3,0]]],[[[5,0],[6,0],[6,1],[5,0]]]]}},
      {"type":"Feature","properties":{"state":"North","district":"C"},"geometry":null}]}""")
    p = PG.read_polygons(spark, str(path))
    assert rows(p, "region", "entity", "code") == [("North", "A", "1"), ("North", "B", "1"), ("North", "C", None)]
    areas = {r["entity"]: [x > 0 for x in r["a"]] for r in p.filter("rings is not null").select(
        "entity", F.transform("rings", PG.signed_area).alias("a")).collect()}
    assert areas == {"A": [True, False], "B": [True, True]}
    assert rows(PG.duplicate_codes(p).filter("code is not null")) == [("1", 2)]
    bad = {r["name"] for r in Q.failed(PG.polygon_checks(p, expected=3)).collect()}
    assert bad == {"no_missing"}


def test_a_point_in_two_polygons(spark):
    shapes = spark.createDataFrame([("r", "one", [box(0.0, 0.0, 2.0, 2.0)]), ("r", "two", [box(1.0, 0.0, 3.0, 2.0)])], DDL)
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (2, 1.5, 0.5), (3, 9.0, 9.0)], "id int, lon double, lat double")
    assert rows(S.point_in_polygon(df, shapes, KEYS, 1.0, on_multiple="first"), "id", "entity") == [
        (1, "one"), (2, "one"), (2, "one"), (3, None)]
    assert S.point_in_polygon(df, shapes, KEYS, 1.0, "inner").count() == 5
    with pytest.raises(Exception, match="more than one polygon"):
        S.point_in_polygon(df, shapes, KEYS, 1.0, "inner", on_multiple="error").collect()
    clear = df.filter("id <> 2")
    assert rows(S.point_in_polygon(clear, shapes, KEYS, 1.0, "inner", on_multiple="error"), "id", "entity") == [(1, "one")]


def test_same_names_in_two_regions_are_apart(spark):
    shapes = spark.createDataFrame([("r", "x", [box(0.0, 0.0, 1.0, 1.0)]), ("s", "x", [box(1.0, 0.0, 2.0, 1.0)])], DDL)
    assert rows(S.adjacency(shapes, KEYS, 0.5)) == [("r", "x", "s", "x"), ("s", "x", "r", "x")]
