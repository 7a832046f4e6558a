"""Panel builders: from raw points and polygons to entity-day and cell-day tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymosaic.functions.calendar import AUTUMN, Season, in_season, season_dates, with_date_parts
from daymosaic.operators import neighbours as NB
from daymosaic.operators import panel as P
from daymosaic.operators import quality as Q
from daymosaic.operators import spatial as S
from daymosaic.operators.joins import lookup
from daymosaic.session import materialise

KEYS = ["region", "entity"]
DAY = ["region", "entity", "date"]
CELL = ["region", "grid_x", "grid_y", "cell_id"]


def count_panel(events: DataFrame, polygons: DataFrame, years: Sequence[int], tile: float,
                season: Season = AUTUMN) -> DataFrame:
    """Point events to daily counts per polygon, every season date present.

    Filter, spatial join, partial count, zero fill: one chain, no action.
    """
    rows = events.filter(in_season("date", years, season))
    placed = S.point_in_polygon(rows, polygons, KEYS, tile, "inner", on_multiple="error")
    skel = P.skeleton(polygons, KEYS, season_dates(years, season))
    return with_date_parts(P.zero_fill(skel, P.daily_count(placed, DAY), DAY, ["event_count"]))


def metric_panel(events: DataFrame, polygons: DataFrame, years: Sequence[int], tile: float,
                 high: Column, day: Column, night: Column, season: Season = AUTUMN,
                 fill_means: bool = True) -> DataFrame:
    """The same with all metrics; ``fill_means=False`` leaves means NULL on empty days."""
    rows = events.filter(in_season("date", years, season))
    placed = S.point_in_polygon(rows, polygons, KEYS, tile, "inner", on_multiple="error")
    obs = P.event_metrics(placed, DAY, high=high, day=day, night=night)
    skel = P.skeleton(polygons, KEYS, season_dates(years, season))
    fill = P.COUNT_METRICS + P.SUM_METRICS + (P.MEAN_METRICS if fill_means else ())
    return with_date_parts(P.zero_fill(skel, obs, DAY, fill))


@dataclass(frozen=True)
class GridPanel:
    """The outputs of one resolution; every field is a DataFrame."""

    mapping: DataFrame
    weights: DataFrame
    cell_days: DataFrame
    grid: DataFrame
    entity: DataFrame
    weighted: DataFrame
    checks: DataFrame


def grid_panel(events: DataFrame, polygons: DataFrame, years: Sequence[int], resolution: float,
               tile: float, season: Season = AUTUMN) -> GridPanel:
    """Cell-day panel, entity-day panel by cell assignment, and area-weighted panel.

    The large table is read once: events are reduced to observed cell-days,
    which are written to the shared folder and feed all three panels. Cells and
    weights depend on the polygons only.
    """
    overlaps = materialise(S.cell_overlaps(polygons, KEYS, resolution), "overlaps")
    weights = S.overlap_weights(overlaps)
    mapping = materialise(S.assign_cells(overlaps, polygons, resolution, tile), "mapping")
    rows = events.filter(in_season("date", years, season))
    placed = S.point_in_polygon(rows, polygons, KEYS, tile, "inner", on_multiple="error").drop("entity")
    cell_days = materialise(
        NB.with_grid(placed, resolution).groupBy(*CELL, "date").agg(
            F.count(F.lit(1)).alias("event_count"), F.sum("measure").alias("measure_sum")),
        "cell-days")
    dates = season_dates(years, season)
    fill = ["event_count", "measure_sum"]
    cells = mapping.select(*CELL, "entity")
    grid = P.zero_fill(P.skeleton(cells, [*CELL, "entity"], dates), cell_days, [*CELL, "date"], fill)
    grid = with_date_parts(grid).withColumn("resolution_degrees", F.lit(resolution))
    by_entity = cell_days.join(cells, CELL).groupBy(*DAY).agg(
        F.sum("event_count").alias("event_count"), F.sum("measure_sum").alias("measure_sum"))
    skel = P.skeleton(polygons, KEYS, dates)
    entity = with_date_parts(P.zero_fill(skel, by_entity, DAY, fill))
    split = P.weighted_split(cell_days.select("cell_id", "date", "event_count"),
                             weights.select("cell_id", *KEYS, "area_weight"), "cell_id", DAY)
    weighted = P.zero_fill(skel, split, DAY, ["event_count_weighted"])
    checks = Q.conservation(
        {"cell_days": cell_days, "grid": grid, "entity": entity, "weighted": weighted},
        {"cell_days": "event_count", "grid": "event_count", "entity": "event_count",
         "weighted": "event_count_weighted"})
    return GridPanel(mapping, weights, cell_days, grid, entity, weighted, checks)


def mapping_matches_panel(mapping: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells of the mapping and of the panel are the same, with the same keys."""
    from daymosaic.operators.sets import keys_equal

    one = keys_equal(mapping.select(*CELL), grid.select(*CELL).distinct(), CELL)
    return Q.checks(one, [("same_cells", F.col("equal"), F.col("left_only") + F.col("right_only"))])


def enrich_grid(grid: DataFrame, side: DataFrame, values: Sequence[str]) -> DataFrame:
    """Entity-day side values on every cell-day of the entity; fails if the side repeats an entity-day."""
    return lookup(grid, side.select(*DAY, *values, F.lit(True).alias("side_matched")), DAY).fillna(
        {"side_matched": False})


def enrich_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, matches, and whether the event total survived the join."""
    total = before.agg(F.sum("event_count")).scalar()
    return after.agg(F.count(F.lit(1)).alias("rows"), F.count_if("side_matched").alias("matched"),
                     F.sum("event_count").alias("events")).withColumn(
        "events_preserved", F.col("events") == total)
