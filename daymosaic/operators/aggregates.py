"""Profiles, distributions, balances and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymosaic.functions.numeric import ratio_or_null, ratio_or_zero
from daymosaic.operators.running import percentiles


def distinct_count(df: DataFrame, keys: Sequence[str], col: str, out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(col).alias(out))


def having_more_than(df: DataFrame, keys: Sequence[str], col: str, limit: int = 1) -> DataFrame:
    """Keys with more than ``limit`` distinct values, e.g. an entity in two regions."""
    return distinct_count(df, keys, col).filter(F.col("n") > limit)


def coverage_gaps(df: DataFrame, keys: Sequence[str], date_col: str = "date") -> DataFrame:
    """Per entity and year: rows, first and last date, and days missing in between."""
    return (df.groupBy(*keys, F.year(date_col).alias("year"))
            .agg(F.count(F.lit(1)).alias("rows"), F.min(date_col).alias("first_date"),
                 F.max(date_col).alias("last_date"))
            .withColumn("calendar_days", F.datediff("last_date", "first_date") + 1)
            .withColumn("missing_days", F.col("calendar_days") - F.col("rows")))


def equal_coverage(df: DataFrame, keys: Sequence[str], date_col: str = "date") -> DataFrame:
    """Per year: entities, and how many different row counts they have."""
    per = df.groupBy(*keys, F.year(date_col).alias("year")).agg(F.count(F.lit(1)).alias("rows"))
    return per.groupBy("year").agg(
        F.count(F.lit(1)).alias("entities"), F.count_distinct("rows").alias("distinct_counts"),
        F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frequency and share per value."""
    n = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / n.agg(F.sum("n")).scalar())


def describe(df: DataFrame, keys: Sequence[str], col: str,
             points: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact percentiles per key."""
    basic = df.groupBy(*keys).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"))
    return basic.join(percentiles(df, keys, col, points), list(keys))


def class_balance(df: DataFrame, keys: Sequence[str], col: str,
                  cuts: Sequence[tuple[float, float]]) -> DataFrame:
    """Low / medium / high shares for many (low, high) cut pairs from one scan.

    low: x <= a, medium: a < x <= b, high: x > b.
    """
    x = F.col(col)
    aggs = []
    for i, (a, b) in enumerate(cuts):
        aggs += [F.count_if(x <= a).alias(f"l{i}"), F.count_if((x > a) & (x <= b)).alias(f"m{i}"),
                 F.count_if(x > b).alias(f"h{i}")]
    one = df.groupBy(*keys).agg(F.count(col).alias("n"), *aggs)
    rows = F.array(*[F.struct(
        F.lit(float(a)).alias("low_cut"), F.lit(float(b)).alias("high_cut"),
        F.col(f"l{i}").alias("low"), F.col(f"m{i}").alias("medium"), F.col(f"h{i}").alias("high"))
        for i, (a, b) in enumerate(cuts)])
    out = one.select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "n", "r.*")
    return out.withColumns({f"{c}_share": ratio_or_zero(c, "n") for c in ("low", "medium", "high")})


def share_above(df: DataFrame, keys: Sequence[str], col: str,
                thresholds: Sequence[float]) -> DataFrame:
    """Share of rows above each of many thresholds, from one scan."""
    x = F.col(col)
    one = df.groupBy(*keys).agg(F.count(col).alias("n"), *[
        F.count_if(x > t).alias(f"a{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("above"))
                     for i, t in enumerate(thresholds)])
    return (one.select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "n", "r.*")
            .withColumn("share", ratio_or_zero("above", "n")))


def quantile_balance(df: DataFrame, keys: Sequence[str], col: str,
                     pairs: Sequence[tuple[float, float]]) -> DataFrame:
    """Class shares when the cut pair is a pair of the group's own quantiles."""
    points = sorted({p for pair in pairs for p in pair})
    cuts = percentiles(df, keys, col, points)
    counts = df.groupBy(*keys, F.col(col).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    name = lambda p: f"p{round(p * 100):02d}"
    joined = counts.join(cuts, list(keys))
    aggs = [F.sum("_n").alias("n")]
    for i, (a, b) in enumerate(pairs):
        lo, hi, x = F.col(name(a)), F.col(name(b)), F.col("_x")
        aggs += [F.max(lo).alias(f"a{i}"), F.max(hi).alias(f"b{i}"),
                 F.sum(F.when(x <= lo, F.col("_n")).otherwise(0)).alias(f"l{i}"),
                 F.sum(F.when((x > lo) & (x <= hi), F.col("_n")).otherwise(0)).alias(f"m{i}"),
                 F.sum(F.when(x > hi, F.col("_n")).otherwise(0)).alias(f"h{i}")]
    one = joined.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(float(a)).alias("low_quantile"), F.lit(float(b)).alias("high_quantile"),
        F.col(f"a{i}").alias("low_cut"), F.col(f"b{i}").alias("high_cut"),
        F.col(f"l{i}").alias("low"), F.col(f"m{i}").alias("medium"), F.col(f"h{i}").alias("high"))
        for i, (a, b) in enumerate(pairs)])
    out = one.select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "n", "r.*")
    return out.withColumns({f"{c}_share": ratio_or_zero(c, "n") for c in ("low", "medium", "high")})


def unpivot_horizons(df: DataFrame, keep: Sequence[str], stem: str,
                     horizons: Sequence[int]) -> DataFrame:
    """<stem>_t_plus_<h>d columns to (horizon, value) rows."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"{stem}_t_plus_{h}d").alias("value"))
                     for h in horizons])
    return df.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def target_distribution(df: DataFrame, stem: str, horizons: Sequence[int],
                        threshold: float = 2.0) -> DataFrame:
    """Per horizon: mean, median, share of zeros and of labels, label share over +1d."""
    long = unpivot_horizons(df, [], stem, horizons).filter(F.col("value").isNotNull())
    base = long.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean"),
        ratio_or_zero(F.count_if(F.col("value") == 0), F.count(F.lit(1))).alias("zero_share"),
        ratio_or_zero(F.count_if(F.col("value") > threshold), F.count(F.lit(1)))
        .alias("label_share"))
    med = percentiles(long, ["horizon"], "value", [0.5]).withColumnRenamed("p50", "median")
    first = base.filter(F.col("horizon") == min(horizons)).select(F.max("label_share")).scalar()
    return base.join(med, "horizon").withColumn(
        "relative_to_first", ratio_or_null(F.col("label_share"), first))


def pivot_counts(df: DataFrame, rows: Sequence[str], col: str, values: Sequence[object],
                 agg: Column) -> DataFrame:
    """Wide table for a declared list of column values (no extra job to find them)."""
    return df.groupBy(*rows).pivot(col, list(values)).agg(agg)


def split_summary(df: DataFrame, split: str, region: str, y: str) -> DataFrame:
    """Rows, positives and prevalence per split and region, with subtotals."""
    base = df.groupBy(split, region).agg(F.count(F.lit(1)).alias("rows"), F.sum(y).alias("positives"))
    return (base.rollup(split, region)
            .agg(F.sum("rows").alias("rows"), F.sum("positives").alias("positives"),
                 F.grouping_id().alias("level"))
            .withColumn("prevalence", ratio_or_zero("positives", "rows")))


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULLs per column and complete rows, one scan."""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(complete).alias("complete_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"))
                     for i, c in enumerate(cols)])
    return one.select("rows", "complete_rows", F.explode(rows).alias("r")).select(
        "r.column", "rows", "complete_rows", "r.nulls")


def column_extrema(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min, max, total, zero and negative counts per column, one scan."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.sum(x).alias(f"s{i}"),
                 F.count_if(x == 0).alias(f"z{i}"), F.count_if(x < 0).alias(f"g{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"),
        F.col(f"s{i}").alias("total"), F.col(f"z{i}").alias("zeros"),
        F.col(f"g{i}").alias("negatives")) for i, c in enumerate(cols)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


# Acceptance limits of an experiment against its baseline.
MIN_ONSET_HORIZONS, MAX_F1_DROP, MAX_CONTINUATION_DROP = 3, 0.010, 0.020


def acceptance(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per arm: average F1, deltas to the baseline, four criteria, and their AND.

    Both tables hold (horizon, f1, onset_recall, continuation_recall); results
    also holds arm.
    """
    b = baseline.select("horizon", *[F.col(c).alias(f"base_{c}") for c in
                                     ("f1", "onset_recall", "continuation_recall")])
    j = results.join(b, "horizon")
    delta = lambda c: F.col(c) - F.col(f"base_{c}")
    out = j.groupBy("arm").agg(
        F.avg("f1").alias("average_f1"), F.avg("base_f1").alias("baseline_average_f1"),
        F.count_if(delta("onset_recall") > 0).alias("onset_horizons_improved"),
        F.max(delta("f1")).alias("max_f1_delta"), F.min(delta("f1")).alias("min_f1_delta"),
        F.min(delta("continuation_recall")).alias("min_continuation_delta"))
    tests = {"average_f1_ok": F.col("average_f1") >= F.col("baseline_average_f1"),
             "onset_ok": F.col("onset_horizons_improved") >= MIN_ONSET_HORIZONS,
             "f1_drop_ok": F.col("min_f1_delta") >= -MAX_F1_DROP,
             "continuation_ok": F.col("min_continuation_delta") >= -MAX_CONTINUATION_DROP}
    out = out.withColumns(tests)
    accepted = F.lit(True)
    for t in tests:
        accepted = accepted & F.col(t)
    return out.withColumn("accepted", accepted)


def prob_summary(df: DataFrame, keys: Sequence[str], score: str,
                 points: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 0.90)) -> DataFrame:
    """Mean and exact percentiles of a score per key."""
    base = df.groupBy(*keys).agg(F.count(score).alias("n"), F.avg(score).alias("mean"))
    return base.join(percentiles(df, keys, score, points), list(keys))
