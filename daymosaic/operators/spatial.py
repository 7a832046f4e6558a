"""Polygons, points and grid cells as joins over edges and tiles.

Polygons are rows (keys..., rings array<array<struct<x,y>>>), rings closed,
outer rings counter-clockwise and holes clockwise (``sources.polygons`` orients
them). No geometry library is used and nothing is collected: a polygon becomes
edges, edges are indexed by tile, and points meet them in an equi-join.

Border rule: an edge counts for y1 <= y < y2 (half open), so a point on a
shared border belongs to at most one side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.functions import geo
from daymosaic.operators.neighbours import neighbour_keys

# Overlaps up to this area count as no overlap; areas this close tie.
MIN_AREA_M2 = 1.0
TIE_M2 = 1.0


def ring_edges(ring: Column) -> Column:
    """array<struct<x1,y1,x2,y2>> of a closed ring."""
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(
        F.get(ring, i - 1)["x"].alias("x1"), F.get(ring, i - 1)["y"].alias("y1"),
        F.get(ring, i)["x"].alias("x2"), F.get(ring, i)["y"].alias("y2")))


def edge_table(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per polygon edge."""
    return (polygons.select(*keys, F.posexplode("rings").alias("ring_no", "ring"))
            .select(*keys, "ring_no", F.posexplode(ring_edges(F.col("ring"))).alias("edge_no", "e"))
            .select(*keys, "ring_no", "edge_no", "e.*"))


def _tile(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("bigint")


def tile_index(polygons: DataFrame, keys: Sequence[str], tile: float) -> DataFrame:
    """(keys, tile_x, tile_y, edges): the edges a ray to the right can cross.

    Each edge is filed under the tile rows it spans; a tile keeps the edges of
    its row that end right of its left side. The list is bounded by one
    polygon's outline inside one row of tiles.
    """
    e = edge_table(polygons, keys)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = (e.filter("y1 <> y2")
            .withColumn("tile_y", F.explode(F.sequence(_tile(low, tile), _tile(high, tile))))
            .groupBy(*keys, "tile_y")
            .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"),
                 F.min(F.least("x1", "x2")).alias("_x0"), F.max(F.greatest("x1", "x2")).alias("_x1")))
    tiles = rows.withColumn("tile_x", F.explode(F.sequence(
        _tile(F.col("_x0"), tile), _tile(F.col("_x1"), tile))))
    left = F.col("tile_x") * F.lit(tile)
    return tiles.select(*keys, "tile_x", "tile_y", F.filter(
        "edges", lambda g: F.greatest(g["x1"], g["x2"]) >= left).alias("edges")
    ).filter(F.size("edges") > 0)


def _crosses(g: Column, x: Column, y: Column) -> Column:
    straddles = (g["y1"] > y) != (g["y2"] > y)
    at = g["x1"] + (y - g["y1"]) * (g["x2"] - g["x1"]) / (g["y2"] - g["y1"])
    return straddles & (x < at)


def point_in_polygon(points: DataFrame, polygons: DataFrame, keys: Sequence[str], tile: float,
                     how: str = "left", lon: str = "lon", lat: str = "lat",
                     match: Sequence[str] = (), on_multiple: str = "all") -> DataFrame:
    """Attach the polygon that holds each point ('left' keeps unmatched points).

    ``on_multiple`` says what happens to a point in overlapping polygons: "all"
    gives a row for each, "error" fails at run time, "first" takes the first
    polygon by key. For the last two a tile brings all its polygons in one row,
    so the points are neither numbered nor moved again.

    One equi-join on the tile with the ray parity as a join condition, so there
    is no pair table to group afterwards. The index is broadcast or shuffled by
    its size; a hot tile on the point side is split by the skew join. ``match``
    names columns that must also agree (same name on both sides).
    """
    index = tile_index(polygons, keys, tile)
    renamed = index.select(*[F.col(k).alias(f"_m_{k}") if k in match else F.col(k) for k in keys],
                           F.col("tile_x").alias("_tx"), F.col("tile_y").alias("_ty"),
                           F.col("edges").alias("_edges"))
    x, y = F.col(lon), F.col(lat)
    inside = F.size(F.filter("_edges", lambda g: _crosses(g, x, y))) % 2 == 1
    on = (_tile(x, tile) == F.col("_tx")) & (_tile(y, tile) == F.col("_ty")) & inside
    for k in match:
        on = on & (F.col(k) == F.col(f"_m_{k}"))
    if on_multiple == "all":
        return points.join(renamed, on, how).drop("_tx", "_ty", "_edges", *[f"_m_{k}" for k in match])
    polys = index.groupBy(F.col("tile_x").alias("_tx"), F.col("tile_y").alias("_ty")).agg(
        F.sort_array(F.collect_list(F.struct(*keys, "edges"))).alias("_polys"))

    def holds(p: Column) -> Column:
        ok = F.size(F.filter(p["edges"], lambda g: _crosses(g, x, y))) % 2 == 1
        for k in match:
            ok = ok & (p[k] == F.col(k))
        return ok
    at = (_tile(x, tile) == F.col("_tx")) & (_tile(y, tile) == F.col("_ty"))
    out = points.join(polys, at, "left").withColumn("_hits", F.filter("_polys", holds))
    if on_multiple == "error":
        bad = F.when(F.size("_hits") > 1, F.raise_error(F.lit("a point lies in more than one polygon")))
        out = out.withColumn("_bad", bad).filter(F.col("_bad").isNull()).drop("_bad")
    first = F.get("_hits", F.lit(0))
    if how == "inner":
        out = out.filter(F.size("_hits") > 0)
    return out.withColumns({k: first[k] for k in keys if k not in match}).drop("_tx", "_ty", "_polys", "_hits")


def multi_match(joined: DataFrame, point_key: Sequence[str], entity: str) -> DataFrame:
    """Points that fell into more than one polygon."""
    return (joined.filter(F.col(entity).isNotNull()).groupBy(*point_key)
            .agg(F.count(F.lit(1)).alias("matches")).filter("matches > 1"))


def unmatched_report(joined: DataFrame, entity: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Matched and unmatched counts and the bounding box of the unmatched."""
    out = F.col(entity).isNull()
    return joined.agg(
        F.count(F.lit(1)).alias("points"), F.count(entity).alias("matched"),
        F.count_if(out).alias("unmatched"),
        F.min(F.when(out, F.col(lon))).alias("lon_min"), F.max(F.when(out, F.col(lon))).alias("lon_max"),
        F.min(F.when(out, F.col(lat))).alias("lat_min"), F.max(F.when(out, F.col(lat))).alias("lat_max"))


def unmatched_sample(joined: DataFrame, entity: str, row_key: Sequence[str], n: int = 20) -> DataFrame:
    """The ``n`` unmatched rows whose key hashes lowest, to look at: the same ones in every run, from all over the table."""
    out = joined.filter(F.col(entity).isNull())
    order = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in row_key]))
    return out.withColumn("_hash", order).orderBy("_hash", *row_key).limit(n).drop("_hash")


def interior_points(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One point inside each polygon: the middle of the widest span at mid-height."""
    all_edges = F.flatten(F.transform("rings", ring_edges))
    ys = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["y"])))
    p = polygons.select(*keys, all_edges.alias("edges"),
                        ((F.array_min(ys) + F.array_max(ys)) / 2).alias("lat"))
    y = F.col("lat")
    xs = F.array_sort(F.transform(
        F.filter("edges", lambda g: (g["y1"] > y) != (g["y2"] > y)),
        lambda g: g["x1"] + (y - g["y1"]) * (g["x2"] - g["x1"]) / (g["y2"] - g["y1"])))
    p = p.select(*keys, "lat", xs.alias("xs"))
    spans = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(
        (F.get(F.col("xs"), (2 * i + 1).cast("int")) - F.get(F.col("xs"), (2 * i).cast("int"))).alias("w"),
        ((F.get(F.col("xs"), (2 * i + 1).cast("int")) + F.get(F.col("xs"), (2 * i).cast("int"))) / 2)
        .alias("mid")))
    return p.select(*keys, F.array_max(spans)["mid"].alias("lon"), "lat")


def adjacency(polygons: DataFrame, keys: Sequence[str], tile: float, tolerance: float = 1e-9) -> DataFrame:
    """Directed pairs of polygons that touch: the keys of both, named as in ``neighbour_keys``.

    Two polygons that touch without overlapping always have a corner of one on
    the outline of the other, so corners are matched to nearby edges by tile.
    """
    e = edge_table(polygons, keys)
    own = F.struct(*keys)
    corners = (e.select(own.alias("a"), F.col("x1").alias("px"), F.col("y1").alias("py"))
               .distinct()
               .withColumns({"tx": _tile(F.col("px"), tile), "ty": _tile(F.col("py"), tile)}))
    span = lambda p, q: F.explode(F.sequence(
        _tile(F.least(p, q) - tolerance, tile), _tile(F.greatest(p, q) + tolerance, tile)))
    filed = (e.select(own.alias("b"), "x1", "y1", "x2", "y2")
             .withColumn("tx", span("x1", "x2")).withColumn("ty", span("y1", "y2")))
    near = corners.join(filed, ["tx", "ty"]).filter("a <> b")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy)
               / length2).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ox, oy = F.col("px") - (F.col("x1") + t * dx), F.col("py") - (F.col("y1") + t * dy)
    touch = near.filter(ox * ox + oy * oy <= tolerance * tolerance).select("a", "b").distinct()
    pairs = touch.select(F.explode(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*").distinct()
    return pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys],
                        *[F.col(f"b.{k}").alias(n) for k, n in zip(keys, neighbour_keys(keys))])


def asymmetric_pairs(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs whose reverse is missing."""
    near = neighbour_keys(keys)
    back = edges.select(*[F.col(n).alias(k) for k, n in zip(keys, near)], *[F.col(k).alias(n) for k, n in zip(keys, near)])
    return edges.join(back, [*keys, *near], "left_anti")


def cell_overlaps(polygons: DataFrame, keys: Sequence[str], resolution: float) -> DataFrame:
    """(keys, grid_x, grid_y, area_m2): cell and polygon overlap in equal-area metres.

    The area under each edge, clamped to the cell, is added up with the sign of
    the edge's direction. Edges are cut at grid columns. Where an edge passes
    through a cell its clamped mean height is used; cells wholly below it get
    the full height, from pieces already summed per column and row, so the
    expansion does not grow with the number of edges.
    """
    r = resolution
    lowest = F.array_min(F.flatten(F.transform("rings", lambda g: F.transform(g, lambda q: q["y"]))))
    based = polygons.withColumn("_base", geo.grid_index(lowest, r))
    e = edge_table(based, [*keys, "_base"]).filter("x1 <> x2").select(
        *keys, "_base", "x1", "x2", F.least("x1", "x2").alias("_l"), F.greatest("x1", "x2").alias("_r"),
        geo.metric_x(F.col("x1")).alias("px1"), geo.metric_x(F.col("x2")).alias("px2"),
        geo.metric_y(F.col("y1")).alias("py1"), geo.metric_y(F.col("y2")).alias("py2"))
    e = e.withColumn("grid_x", F.explode(F.sequence(
        geo.grid_index(F.col("_l"), r), geo.grid_index(F.col("_r"), r))))
    x0 = geo.metric_x(F.col("grid_x") * F.lit(r))
    x1 = geo.metric_x((F.col("grid_x") + 1) * F.lit(r))
    a = F.greatest(F.least("px1", "px2"), x0)
    b = F.least(F.greatest("px1", "px2"), x1)
    slope = (F.col("py2") - F.col("py1")) / (F.col("px2") - F.col("px1"))
    y_at = lambda x: F.col("py1") + (x - F.col("px1")) * slope
    p = e.select(*keys, "_base", "grid_x", (b - a).alias("dx"), F.signum(F.col("x2") - F.col("x1")).alias("sign"),
                 y_at(a).alias("ya"), y_at(b).alias("yb")).filter("dx > 0")
    guard = 1e-6
    p = p.select(*keys, "_base", "grid_x", (F.col("sign") * F.col("dx")).alias("dx"),
                 F.least("ya", "yb").alias("lo"), F.greatest("ya", "yb").alias("hi"))
    p = p.withColumns({"row_lo": geo.grid_index(geo.latitude_of(F.col("lo")) - guard, r),
                       "row_hi": geo.grid_index(geo.latitude_of(F.col("hi")) + guard, r)})
    y0 = geo.metric_y(F.col("grid_y") * F.lit(r))
    y1 = geo.metric_y((F.col("grid_y") + 1) * F.lit(r))
    through = p.withColumn("grid_y", F.explode(F.sequence(
        F.greatest("row_lo", "_base"), "row_hi"))).withColumns(
        {"Y0": y0, "Y1": y1})
    lo, hi, Y0, Y1 = (F.col(c) for c in ("lo", "hi", "Y0", "Y1"))
    cl = F.greatest(Y0, F.least(Y1, lo))
    ch = F.greatest(Y0, F.least(Y1, hi))
    above = F.greatest(F.lit(0.0), hi - F.greatest(lo, Y1))
    mean = F.when(hi > lo, (above * (Y1 - Y0) + (ch - cl) * ((cl + ch) / 2 - Y0)) / (hi - lo)
                  ).otherwise(cl - Y0)
    part1 = through.groupBy(*keys, "grid_x", "grid_y").agg(F.sum(F.col("dx") * mean).alias("v"))
    columns = (p.filter("row_lo > _base").groupBy(*keys, "_base", "grid_x", "row_lo")
               .agg(F.sum("dx").alias("dx")))
    part2 = columns.withColumn("grid_y", F.explode(F.sequence(F.col("_base"), F.col("row_lo") - 1)))
    part2 = part2.select(*keys, "grid_x", "grid_y", (F.col("dx") * (y1 - y0)).alias("v"))
    return (part1.unionByName(part2).groupBy(*keys, "grid_x", "grid_y")
            .agg(F.abs(F.sum("v")).alias("area_m2")).filter(F.col("area_m2") > MIN_AREA_M2))


def overlap_weights(overlaps: DataFrame, region: str = "region") -> DataFrame:
    """Add the region-scoped cell_id and the share of each entity in its cell."""
    w = Window.partitionBy(region, "grid_x", "grid_y")
    return overlaps.withColumns({
        "cell_id": geo.cell_id(F.col(region), F.col("grid_x"), F.col("grid_y")),
        "area_weight": F.col("area_m2") / F.sum("area_m2").over(w)})


def eligible_cells(overlaps: DataFrame, region: str = "region") -> DataFrame:
    """Every cell of a region that overlaps one of its polygons."""
    return overlaps.select(region, "grid_x", "grid_y").distinct().withColumn(
        "cell_id", geo.cell_id(F.col(region), F.col("grid_x"), F.col("grid_y")))


def assign_cells(overlaps: DataFrame, polygons: DataFrame, resolution: float, tile: float,
                 region: str = "region", entity: str = "entity") -> DataFrame:
    """One entity per cell: the polygon holding the cell's centre (first by name),
    else the largest overlap (areas within 1 m2 tie, first by name)."""
    key = [region, "grid_x", "grid_y", "cell_id"]
    cells = eligible_cells(overlaps, region)
    lon, lat = geo.cell_centroid(F.col("grid_x"), F.col("grid_y"), resolution)
    held = point_in_polygon(cells.withColumns({"lon": lon, "lat": lat}), polygons,
                            [region, entity], tile, "inner", match=[region])
    centre = held.groupBy(*key).agg(F.min(entity).alias("_centre"))
    best = Window.partitionBy(region, "grid_x", "grid_y")
    largest = (overlaps.withColumn("_max", F.max("area_m2").over(best))
               .filter(F.col("_max") - F.col("area_m2") <= TIE_M2)
               .groupBy(region, "grid_x", "grid_y").agg(F.min(entity).alias("_largest")))
    counts = overlaps.groupBy(region, "grid_x", "grid_y").agg(
        F.count(F.lit(1)).alias("overlap_entity_count"))
    out = (counts.join(largest, [region, "grid_x", "grid_y"])
           .withColumn("cell_id", geo.cell_id(F.col(region), F.col("grid_x"), F.col("grid_y")))
           .join(centre, key, "left"))
    return out.select(*key, F.coalesce("_centre", "_largest").alias(entity),
                      F.when(F.col("_centre").isNotNull(), "centroid")
                      .otherwise("largest_overlap_fallback").alias("assignment_method"),
                      "overlap_entity_count")
