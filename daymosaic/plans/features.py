"""Feature tables. Each plan keeps one shuffle key from panel to targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymosaic.functions import features as X
from daymosaic.functions.calendar import cycle, day_of_season, with_date_parts
from daymosaic.operators import lags as L
from daymosaic.operators.joins import join_one_to_one
from daymosaic.operators.neighbours import neighbour_context

KEYS = ("region", "entity")
STEMS = {"event_count": "event", "measure_sum": "measure"}
YEAR_PERIOD, SEASON_PERIOD = 365.25, 61.0
SPARSE = {"mean_3d": (1, 2, 3), "sparse_mean_7d": (1, 2, 3, 5, 7),
          "sparse_mean_14d": (1, 2, 3, 5, 7, 14)}


def with_year_cycle(df: DataFrame, date_col: str = "date") -> DataFrame:
    doy = F.dayofyear(date_col)
    sin, cos = cycle(doy, YEAR_PERIOD)
    return df.withColumns({"day_of_year": doy, "sin_year": sin, "cos_year": cos})


def with_sparse_means(df: DataFrame, stems: Sequence[str], skip_null: bool) -> DataFrame:
    """Means over the listed lags only: 'sparse 7d' uses days 1, 2, 3, 5 and 7."""
    return df.withColumns({f"{s}_{name}": X.row_mean([f"{s}_lag_{k}d" for k in ks], skip_null)
                           for s in stems for name, ks in SPARSE.items()})


def features_rows(panel: DataFrame, side: DataFrame, keys: Sequence[str] = KEYS,
                  threshold: float = 2.0) -> DataFrame:
    """Positional lags (1, 3, 7 rows), full-window means, next-row target.

    Row lags reach across a season gap, as the first generation did; use
    ``features_calendar`` for day-exact history.
    """
    f = join_one_to_one(panel, side, [*keys, "date"])
    f = L.lag_rows(f, keys, {"event_count": "event"})
    f = L.rolling_mean_prev(f, keys, "event_count", {"event_mean_3d": 3, "event_mean_7d": 7})
    f = L.lead_rows(f, keys, "event_count", "target_event_count")
    f = f.dropna(subset=["event_lag_7d", "event_mean_7d", "target_event_count"])
    dos = day_of_season("date")
    sin, cos = cycle(dos, SEASON_PERIOD)
    return f.withColumns({"day_of_season": dos, "season_sin": sin, "season_cos": cos,
                          "target": X.above("target_event_count", threshold)})


def features_calendar(panel: DataFrame, side: DataFrame, keys: Sequence[str] = KEYS,
                      lags: Sequence[int] = L.DEFAULT_LAGS,
                      horizons: Sequence[int] = L.DEFAULT_HORIZONS,
                      drop_incomplete: bool = True) -> DataFrame:
    """Day-exact lags, sparse means (missing lags skipped), leads at every horizon."""
    f = join_one_to_one(panel, side, [*keys, "date"])
    f = with_year_cycle(f)
    f = L.lags_and_leads(f, keys, STEMS, lags, list(STEMS), horizons)
    f = with_sparse_means(f, list(STEMS.values()), skip_null=True)
    if not drop_incomplete:
        return f
    return f.dropna(subset=[f"{s}_lag_{k}d" for s in STEMS.values() for k in lags]
                    + [f"{c}_t_plus_{h}d" for c in STEMS for h in horizons])


GRID_COLUMNS = ("active_cell_count", "max_cell_event_count", "max_cell_measure", "max_cell_share")


def features_grid(panel: DataFrame, cells: DataFrame, side: DataFrame,
                  keys: Sequence[str] = KEYS, lags: Sequence[int] = L.DEFAULT_LAGS,
                  threshold: float = 2.0) -> DataFrame:
    """Entity panel with cell-derived features; lags of six metrics; nullable label.

    ``cells`` is the entity-day cell roll-up. Rows are kept even where lags or
    the target are unknown.
    """
    f = panel.join(cells.select(*keys, "date", *GRID_COLUMNS), [*keys, "date"], "left")
    f = f.fillna(0, subset=list(GRID_COLUMNS)).join(side, [*keys, "date"], "left")
    f = with_year_cycle(with_date_parts(f))
    names = STEMS | {c: c for c in GRID_COLUMNS}
    f = L.lags_and_leads(f, keys, names, lags, list(STEMS), (1,))
    f = with_sparse_means(f, list(STEMS.values()), skip_null=False)
    return f.withColumn("target_label_t_plus_1d",
                        X.above("event_count_t_plus_1d", threshold))


def trend_columns(stem: str) -> dict[str, Column]:
    lag = lambda k: f"{stem}_lag_{k}d"
    return {
        f"{stem}_change_1d": X.change(lag(1), lag(2)),
        f"{stem}_change_3d": X.change(lag(1), lag(3)),
        f"{stem}_change_7d": X.change(lag(1), lag(7)),
        f"{stem}_ratio_recent_vs_3d": X.recent_ratio(lag(1), f"{stem}_mean_3d"),
        f"{stem}_ratio_recent_vs_7d": X.recent_ratio(lag(1), f"{stem}_sparse_mean_7d"),
        f"{stem}_trend_3d": X.slope([lag(3), lag(2), lag(1)]),
        f"{stem}_trend_7d": X.slope([lag(7), lag(5), lag(3), lag(2), lag(1)]),
        f"{stem}_acceleration": X.acceleration(lag(1), lag(2), lag(3)),
    }


def features_trend(f: DataFrame, stems: Sequence[str] = tuple(STEMS.values())) -> DataFrame:
    """Sixteen change, ratio, slope and acceleration columns; a projection only."""
    out: dict[str, Column] = {}
    for s in stems:
        out |= trend_columns(s)
    return f.withColumns(out)


def features_neighbour(f: DataFrame, panel: DataFrame, edges: DataFrame,
                       own_history: bool = False) -> DataFrame:
    """Eight adjacency columns joined by region, entity and date."""
    context = neighbour_context(panel, edges, STEMS, (1, 3, 7), own_history)
    return f.join(context, ["region", "entity", "date"], "left")


def interaction_pairs(source: Mapping[str, str] = STEMS) -> list[tuple[str, str, str, str]]:
    """(product name, ratio name, own column, neighbour column), eight in all."""
    return [(f"{stem}_neighbor_interaction_{when}", f"neighbor_{stem}_relative_{when}",
             col if when == "current" else f"{stem}_{when}", f"neighbor_{stem}_{when}")
            for col, stem in source.items() for when in ("current", "lag_1d", "lag_3d", "lag_7d")]


def interaction_columns(source: Mapping[str, str] = STEMS) -> dict[str, Column]:
    """Own x neighbour products and neighbour / (own + 1) ratios, eight each."""
    out: dict[str, Column] = {}
    for product, ratio, own, near in interaction_pairs(source):
        out[product] = X.interaction(own, near)
        out[ratio] = X.relative(near, own)
    return out


def features_interaction(f: DataFrame) -> DataFrame:
    return f.withColumns(interaction_columns())
