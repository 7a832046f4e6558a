"""Ranks, shares, best rows and ordered reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.functions.numeric import ratio_or_null


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                out: str = "rank") -> DataFrame:
    """Sequential rank. Meant for metric tables: give a full order for fixed ties."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def group_share(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add share of the group total and distance below the group maximum.

    Group totals are a partial aggregate joined back: a window would gather a
    whole group in one task.
    """
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_sum"), F.max(value).alias("_max"))
    return df.join(totals, list(keys)).withColumns({
        "share": ratio_or_null(F.col(value), F.col("_sum")),
        "below_max": F.col("_max") - F.col(value)}).drop("_sum", "_max")


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
             cols: Sequence[str]) -> DataFrame:
    """First row per group by ``order``.

    Ranking within the task first, then across tasks, lets Spark keep one row
    per group and task before the shuffle (the rank filter is pushed into a
    window-group limit), so a hot group is not gathered.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.select(*keys, *cols, F.row_number().over(w).alias("_rn"))
            .filter("_rn = 1").drop("_rn"))


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows of the whole table (a bounded heap per task, then one merge)."""
    return df.orderBy(*order).limit(n)


def dates_desc(df: DataFrame, date_col: str) -> DataFrame:
    return df.select(date_col).distinct().orderBy(F.col(date_col).desc())
