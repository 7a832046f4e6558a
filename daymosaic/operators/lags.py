"""Calendar and positional lags, leads and rolling means.

All calendar lags and leads of a panel are range frames over one window
specification, so the panel is shuffled and sorted once however many lags are
asked for. An entity's series is bounded by the calendar, not by its events.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.functions.calendar import day_index

DEFAULT_LAGS = (1, 2, 3, 5, 7, 14)
DEFAULT_HORIZONS = (1, 2, 3, 5, 7)


def shift_days(df: DataFrame, keys: Sequence[str], shifts: Mapping[str, tuple[str, int]],
               date_col: str = "date") -> DataFrame:
    """Add out = value of a column ``offset`` calendar days away.

    ``shifts`` maps an output name to (source column, offset); negative offsets
    look back. A date without a row gives NULL.
    """
    w = Window.partitionBy(*keys).orderBy(day_index(date_col))
    return df.withColumns({out: F.max(src).over(w.rangeBetween(k, k))
                           for out, (src, k) in shifts.items()})


def lag_days(df: DataFrame, keys: Sequence[str], names: Mapping[str, str],
             days: Sequence[int] = DEFAULT_LAGS, date_col: str = "date") -> DataFrame:
    """``names`` maps a source column to the stem of its lag columns."""
    return shift_days(df, keys, {f"{stem}_lag_{k}d": (src, -k)
                                 for k in days for src, stem in names.items()}, date_col)


def lead_days(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
              days: Sequence[int] = DEFAULT_HORIZONS, date_col: str = "date") -> DataFrame:
    return shift_days(df, keys, {f"{c}_t_plus_{h}d": (c, h) for h in days for c in cols}, date_col)


def lags_and_leads(df: DataFrame, keys: Sequence[str], names: Mapping[str, str],
                   lags: Sequence[int] = DEFAULT_LAGS, lead_cols: Sequence[str] = (),
                   horizons: Sequence[int] = DEFAULT_HORIZONS,
                   date_col: str = "date") -> DataFrame:
    """Every lag and lead in a single pass."""
    shifts = {f"{stem}_lag_{k}d": (src, -k) for k in lags for src, stem in names.items()}
    shifts |= {f"{c}_t_plus_{h}d": (c, h) for h in horizons for c in lead_cols}
    return shift_days(df, keys, shifts, date_col)


def lag_days_by_join(df: DataFrame, keys: Sequence[str], names: Mapping[str, str],
                     days: Sequence[int], date_col: str = "date") -> DataFrame:
    """The same lags by shifted-date joins: the independent form the audits use."""
    out = df
    for k in days:
        past = df.select(*keys, F.date_add(date_col, k).alias(date_col),
                         *[F.col(s).alias(f"{stem}_lag_{k}d") for s, stem in names.items()])
        out = out.join(past, [*keys, date_col], "left")
    return out


def lag_rows(df: DataFrame, keys: Sequence[str], names: Mapping[str, str],
             rows: Sequence[int] = (1, 3, 7), date_col: str = "date",
             suffix: Callable[[int], str] = lambda k: f"_lag_{k}d") -> DataFrame:
    """Positional lags: the k-th earlier row, whatever its date."""
    w = Window.partitionBy(*keys).orderBy(date_col)
    return df.withColumns({stem + suffix(k): F.lag(src, k).over(w)
                           for k in rows for src, stem in names.items()})


def lead_rows(df: DataFrame, keys: Sequence[str], src: str, out: str, rows: int = 1,
              date_col: str = "date") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(date_col)
    return df.withColumn(out, F.lead(src, rows).over(w))


def rolling_mean_prev(df: DataFrame, keys: Sequence[str], src: str,
                      windows: Mapping[str, int], date_col: str = "date") -> DataFrame:
    """Mean of the n previous rows, NULL until n values exist."""
    w = Window.partitionBy(*keys).orderBy(date_col)
    def one(n: int):
        frame = w.rowsBetween(-n, -1)
        return F.when(F.count(src).over(frame) == n, F.avg(src).over(frame))
    return df.withColumns({out: one(n) for out, n in windows.items()})


def is_ordered(df: DataFrame, keys: Sequence[str], sequence: Sequence[str],
               date_col: str = "date") -> DataFrame:
    """Rows whose date is earlier than the previous row's in the given order."""
    w = Window.partitionBy(*keys).orderBy(*sequence)
    return (df.withColumn("previous_date", F.lag(date_col).over(w))
            .filter(F.col("previous_date") > F.col(date_col)))
