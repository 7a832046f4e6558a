"""Quantiles of any window from mergeable sketches of its days.

Exact percentiles (``running.percentiles``) rank all rows of each window anew. A KLL sketch of a day holds a bounded
number of values whatever the day's rows, and sketches merge: the rows are scanned once, and every later window, of any
length or set of keys, reads the days' sketches alone. The rank of a returned value is off by at most ``rank_error(k)`` of the
window's rows in 99 of 100 windows; up to k rows it is exact.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch.
K = 800


def rank_error(k: int = K) -> float:
    """Normalised rank error of one quantile at 99 % confidence, as published for KLL sketches."""
    return 2.296 / k ** 0.9021


def day_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = K, date_col: str = "date") -> DataFrame:
    """keys, date, sketch: one row for each key and day. NULL values are left out, a day of NULLs has no row."""
    rows = df.filter(F.col(value).isNotNull())
    return rows.groupBy(*keys, date_col).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged(days: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """keys, n, sketch: sketches merged over all other keys and days."""
    return days.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")).withColumn(
        "n", F.kll_sketch_get_n_double("sketch"))


def trailing(days: DataFrame, keys: Sequence[str], ends: Sequence[dt.date], lengths: Sequence[int], k: int = K,
             date_col: str = "date") -> DataFrame:
    """keys, ending, days, n, sketch: the sketch of each window of ``lengths`` days up to and with each of ``ends``.

    A day's sketch is copied to the windows that it is in, inside its row; both lists are short.
    """
    windows = F.array(*[F.struct(F.lit(e).alias("ending"), F.lit(n).alias("days")) for e in ends for n in lengths])
    near = F.filter(windows, lambda w: (F.col(date_col) <= w["ending"]) & (F.datediff(w["ending"], F.col(date_col)) < w["days"]))
    rows = days.select(*keys, "sketch", F.explode(near).alias("w")).select(*keys, "w.*", "sketch")
    return merged(rows, [*keys, "ending", "days"], k)


def quantiles(sketched: DataFrame, points: Sequence[float], prefix: str = "p") -> DataFrame:
    """The sketch column replaced by its quantiles, p50 for 0.5 and so on."""
    return sketched.withColumns({f"{prefix}{round(p * 100):02d}": F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))
                                 for p in points}).drop("sketch")
