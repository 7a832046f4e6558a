"""Keyed joins, lookups, reconciliation and upserts.

Spark broadcasts a side by itself when its statistics are below the session's
threshold, and shuffles it otherwise. An aggregate, however small, is estimated
at its input's size, so ``join_small`` counts such a table before it decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.functions.numeric import close_to
from daymosaic.session import materialise

#: Rows up to which a counted table is broadcast.
SMALL = 10_000


def unique(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """The same rows; fails at run time if a key without NULLs repeats.

    The count runs over the join keys, so it shares the partitioning and the
    order of a join on them.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    bad = F.when((n > 1) & known, F.raise_error(F.lit(f"{label}: key is not unique")))
    return df.withColumn("_bad", bad).filter(F.col("_bad").isNull()).drop("_bad")


def join_one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails at run time if a key repeats on either side."""
    return unique(a, keys, "left side").join(unique(b, keys, "right side"), list(keys), "inner")


def join_small(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join rows with an aggregate over few keys, without moving the rows.

    The table is written once and counted: up to SMALL rows it is broadcast,
    beyond it is joined by shuffle, where adaptive execution splits hot keys.
    """
    table = materialise(table, "small")
    return df.join(F.broadcast(table) if table.count() <= SMALL else table, list(keys), how)


def lookup(facts: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Many-to-one left join; fails at run time if the dimension repeats a key."""
    return facts.join(unique(dim, keys, "lookup table"), list(keys), "left")


def lookup_report(joined: DataFrame, probe: str) -> DataFrame:
    return joined.agg(F.count(F.lit(1)).alias("rows"),
                      F.count(probe).alias("matched"),
                      F.count_if(F.col(probe).isNull()).alias("unmatched"))


def semi_filter(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_semi")


def anti_report(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that are absent."""
    return expected.select(*keys).distinct().join(actual.select(*keys), list(keys), "left_anti")


def upsert(history: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones with the same key; the rest stays."""
    kept = history.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def align_models(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str],
                 suffixes: tuple[str, str], shared: Sequence[str] = ()) -> DataFrame:
    """Two models' predictions side by side, columns told apart by suffix.

    Fails at run time if a key repeats in either model."""
    left = a.select(*keys, *shared, *[F.col(c).alias(c + suffixes[0]) for c in cols])
    right = b.select(*keys, *[F.col(c).alias(c + suffixes[1]) for c in cols])
    return join_one_to_one(left, right, keys)


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer compare of one value: match counts and the largest difference."""
    left = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = left.join(right, list(keys), "full_outer")
    return both.agg(
        F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()).alias("both"),
        F.count_if(F.col("_in_b").isNull()).alias("left_only"),
        F.count_if(F.col("_in_a").isNull()).alias("right_only"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_difference"))


def value_map(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str,
              fallback: Column | float, out: str) -> DataFrame:
    """Per-key value with a fallback where the key is unknown. The table holds a row per key."""
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return (join_small(df, table.select(*keys, F.col(value).alias("_v")), keys)
            .withColumn(out, F.coalesce("_v", fallback)).drop("_v"))


def phase_column(date_col: str, phases: Sequence[Mapping[str, object]],
                 default: str | None = None) -> Column:
    """Season phase from inclusive month-day ranges held as data.

    Each phase is {'name', 'start': (month, day), 'end': (month, day)}. The
    table is a handful of literals, so it is folded into the row expression
    rather than joined.
    """
    mmdd = F.month(date_col) * 100 + F.dayofmonth(date_col)
    out = F.lit(default).cast("string")
    for p in reversed(list(phases)):
        (m0, d0), (m1, d1) = p["start"], p["end"]
        out = F.when(mmdd.between(m0 * 100 + d0, m1 * 100 + d1), p["name"]).otherwise(out)
    return out


# The three phase conventions in use, kept apart on purpose.
PHASES_BOUNDED = (
    {"name": "Early season", "start": (10, 15), "end": (10, 31)},
    {"name": "Middle season", "start": (11, 1), "end": (11, 15)},
    {"name": "Late season", "start": (11, 16), "end": (11, 23)},
)
PHASES_WHOLE_OCTOBER = (
    {"name": "Early season", "start": (10, 1), "end": (10, 31)},
    {"name": "Middle season", "start": (11, 1), "end": (11, 15)},
    {"name": "Late season", "start": (11, 16), "end": (11, 30)},
)


def phase_join(df: DataFrame, ranges: DataFrame, date_col: str = "date") -> DataFrame:
    """The same with absolute date ranges in a table (start_date, end_date, phase).

    Ranges are unpacked to days first, which turns the range join into an
    equi-join on the date.
    """
    days = ranges.select("phase", F.explode(F.sequence("start_date", "end_date")).alias(date_col))
    return df.join(days, date_col, "left")


def seasonal_prior(live: DataFrame, history: DataFrame, keys: Sequence[str],
                   cols: Sequence[str]) -> DataFrame:
    """Fill missing features from the historical mean at the same keys
    (entity and day of season); ``filled_<col>`` tells which came from there."""
    prior = history.groupBy(*keys).agg(*[F.avg(c).alias(f"_{c}") for c in cols])
    joined = live.join(prior, list(keys), "left")
    added = {f"filled_{c}": F.col(c).isNull() & F.col(f"_{c}").isNotNull() for c in cols}
    values = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")) for c in cols}
    return joined.withColumns(added).withColumns(values).drop(*[f"_{c}" for c in cols])


def compare_columns(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str],
                    tolerance: float) -> DataFrame:
    """Per column: rows that differ beyond tolerance and NULL-pattern differences."""
    left = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(1).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(1).alias("_in_b"))
    both = left.join(right, list(keys), "full_outer")
    aggs = []
    for i, c in enumerate(cols):
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        matched = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
        aggs.append(F.count_if(matched & ~close_to(x, y, tolerance)).alias(f"d{i}"))
        aggs.append(F.count_if(matched & (x.isNull() != y.isNull())).alias(f"n{i}"))
    one = both.agg(F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("unmatched"),
                   *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("different"),
                              F.col(f"n{i}").alias("null_pattern"))
                     for i, c in enumerate(cols)])
    return one.select("unmatched", F.explode(rows).alias("r")).select(
        "r.column", "unmatched", "r.different", "r.null_pattern")
