"""Set operations on keys and rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_missing(*frames: DataFrame) -> DataFrame:
    """Stack frames whose columns differ; absent ones become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keys_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys only in a, keys only in b (with multiplicity), and equality.

    Both sides are counted per key in one aggregate instead of two differences.
    """
    marked = a.select(*keys, F.lit(1).alias("_d")).unionByName(
        b.select(*keys, F.lit(-1).alias("_d")))
    per = marked.groupBy(*keys).agg(F.sum("_d").alias("_d"))
    out = per.agg(F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("left_only"),
                  F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0))
                  .alias("right_only"))
    return out.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def distinct(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()
