"""Neighbour context: adjacency means for entities, eight-cell statistics for grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymosaic.functions import geo
from daymosaic.functions.numeric import ratio_or_null
from daymosaic.operators.lags import lag_days


KEYS = ("region", "entity")


def neighbour_keys(keys: Sequence[str]) -> list[str]:
    """Names of a neighbour's key columns: neighbor for the entity, neighbor_<key> for the rest."""
    return ["neighbor" if k == "entity" else f"neighbor_{k}" for k in keys]


def neighbour_mean(panel: DataFrame, edges: DataFrame, cols: Mapping[str, str],
                   date_col: str = "date", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the adjacent entities' values on the same date.

    ``edges`` holds the keys of an entity and of its neighbour (see
    ``neighbour_keys``); entities of one name in two regions are two entities.
    The panel is joined on the neighbour and averaged per entity and date with
    partial aggregation.
    """
    near = neighbour_keys(keys)
    facts = panel.select(*[F.col(k).alias(n) for k, n in zip(keys, near)], date_col, *cols)
    return (facts.join(edges.select(*keys, *near), near)
            .groupBy(*keys, date_col)
            .agg(*[F.avg(src).alias(out) for src, out in cols.items()]))


def neighbour_context(panel: DataFrame, edges: DataFrame, names: Mapping[str, str],
                      lags: Sequence[int] = (1, 3, 7), own_history: bool = False,
                      date_col: str = "date", keys: Sequence[str] = KEYS) -> DataFrame:
    """Current neighbour means and their calendar lags, per entity and date.

    Output columns are neighbor_<stem>_current and neighbor_<stem>_lag_<k>d.
    By default a lag is the neighbours' mean k days earlier. With
    own_history=True it is the entity's own earlier value, which is what the
    published experiment computed under that name.
    """
    current = neighbour_mean(panel, edges, {s: f"neighbor_{t}_current" for s, t in names.items()},
                             date_col, keys)
    if own_history:
        own = lag_days(panel.select(*keys, date_col, *names), list(keys),
                       {s: f"neighbor_{t}" for s, t in names.items()}, lags, date_col)
        return current.join(own.drop(*names), [*keys, date_col])
    return lag_days(current, list(keys),
                    {f"neighbor_{t}_current": f"neighbor_{t}" for t in names.values()},
                    lags, date_col)


OFFSETS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


def _around(gx: str = "grid_x", gy: str = "grid_y") -> Column:
    return F.explode(F.array(*[F.struct((F.col(gx) + dx).alias("grid_x"),
                                        (F.col(gy) + dy).alias("grid_y"))
                               for dx, dy in OFFSETS]))


def neighbour_degree(cells: DataFrame, region: str = "region") -> DataFrame:
    """Cells that exist among the eight around each cell, inside the same region."""
    key = [region, "grid_x", "grid_y"]
    seen = (cells.select(region, _around().alias("n")).select(region, "n.*")
            .join(cells.select(*key), key, "left_semi")
            .groupBy(*key).agg(F.count(F.lit(1)).alias("physical_neighbor_count")))
    return cells.join(seen, key, "left").fillna({"physical_neighbor_count": 0})


def moore_neighbours(cell_days: DataFrame, cells: DataFrame, dates: Column,
                     in_calendar: Column, region: str = "region",
                     date_col: str = "date") -> DataFrame:
    """Eight-neighbour statistics of the previous day for every cell and date.

    Only cells with events are spread to their neighbours (nearly all cell-days
    are empty), then summed per target cell-day in one shuffle. A target whose
    previous date is outside the calendar gets NULL; inside the calendar a
    silent neighbourhood is 0; a cell without physical neighbours has sum 0 and
    NULL mean. ``in_calendar`` tests the previous date, available as
    ``previous_date``.
    """
    key = [region, "grid_x", "grid_y", date_col]
    spread = (cell_days.filter(F.col("event_count") > 0)
              .select(region, _around().alias("n"), F.date_add(date_col, 1).alias(date_col),
                      "event_count", "measure_sum")
              .select(region, "n.*", date_col, "event_count", "measure_sum"))
    sums = spread.groupBy(*key).agg(
        F.sum("event_count").alias("_events"), F.sum("measure_sum").alias("_measure"),
        F.count(F.lit(1)).alias("_active"), F.max("event_count").alias("_max"))
    skel = neighbour_degree(cells, region).withColumn(date_col, F.explode(dates))
    out = skel.join(sums, key, "left").withColumn("previous_date", F.date_sub(date_col, 1))
    known = in_calendar
    degree = F.col("physical_neighbor_count")
    value = lambda c: F.when(known, F.coalesce(F.col(c), F.lit(0)))
    out = out.withColumns({
        "neighbor_observed_count": F.when(known, degree).otherwise(F.lit(0)),
        "neighbor_event_count": value("_events"), "neighbor_measure_sum": value("_measure"),
        "neighbor_active_count": value("_active"), "neighbor_max_event_count": value("_max")})
    seen = F.col("neighbor_observed_count")
    return out.withColumns({
        "neighbor_event_mean": ratio_or_null(F.col("neighbor_event_count"), seen),
        "neighbor_measure_mean": ratio_or_null(F.col("neighbor_measure_sum"), seen),
        "neighbor_coverage": F.when(known, ratio_or_null(seen, degree)),
    }).drop("_events", "_measure", "_active", "_max", "previous_date")


def neighbour_rollup(cell_neighbours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cell-day neighbour statistics to eight entity-day columns."""
    return cell_neighbours.groupBy(*keys).agg(
        F.avg("neighbor_event_count").alias("neighbor_event_count_lag_1d_mean"),
        F.max("neighbor_event_count").alias("neighbor_event_count_lag_1d_max"),
        F.avg("neighbor_event_mean").alias("neighbor_event_per_neighbor_mean"),
        F.avg("neighbor_measure_sum").alias("neighbor_measure_sum_lag_1d_mean"),
        F.avg("neighbor_measure_mean").alias("neighbor_measure_per_neighbor_mean"),
        F.avg("neighbor_active_count").alias("neighbor_active_cells_lag_1d_mean"),
        F.max("neighbor_max_event_count").alias("neighbor_max_event_count_lag_1d_max"),
        F.avg("neighbor_coverage").alias("neighbor_coverage_mean"))


def with_grid(points: DataFrame, resolution: float, region: str = "region",
              lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add grid_x, grid_y and the region-scoped cell_id."""
    return points.withColumns({
        "grid_x": geo.grid_index(F.col(lon), resolution),
        "grid_y": geo.grid_index(F.col(lat), resolution),
    }).withColumn("cell_id", geo.cell_id(F.col(region), F.col("grid_x"), F.col("grid_y")))
