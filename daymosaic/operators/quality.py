"""Data-quality operators. Each returns checks(name, passed, detail).

Checks are lazy tables like everything else; ``failed`` keeps the bad ones and
``enforce`` is the one action, raising when any is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymosaic.functions.calendar import AUTUMN, Season, in_season
from daymosaic.functions.numeric import close_to
from daymosaic.operators import aggregates as A
from daymosaic.operators import sets as S
from daymosaic.operators.joins import compare_columns, reconcile
from daymosaic.operators.lags import lag_days_by_join
from daymosaic.schemas import COVERAGE_STATES


class CheckFailed(ValueError):
    """Raised by ``enforce`` with the names of the failed checks."""


def checks(one: DataFrame, rows: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Unpack a one-row frame of totals into checks rows."""
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), p.alias("passed"), v.cast("string").alias("detail"))
        for n, p, v in rows])).alias("c")).select("c.*")


def zero(one: DataFrame, names: Sequence[str]) -> DataFrame:
    """Checks that hold when the counter of that name is zero."""
    return checks(one, [(n, F.col(n) == 0, F.col(n)) for n in names])


def all_checks(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def failed(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce("passed", F.lit(False)))


def enforce(df: DataFrame) -> DataFrame:
    """Run the checks and raise if one failed. The table has a row per check."""
    bad = [f"{r['name']} ({r['detail']})" for r in failed(df).collect()]
    if bad:
        raise CheckFailed("; ".join(bad))
    return df


def unique_key(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    extra = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_x"))
    return zero(extra.agg(F.coalesce(F.sum("_x"), F.lit(0)).alias(name)), [name])


def duplicate_keys(df: DataFrame, keys: Sequence[str], sample: int | None = None) -> DataFrame:
    """Repeated keys and their counts; with ``sample``, a top report of the worst."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out if sample is None else out.orderBy(F.col("n").desc(), *keys).limit(sample)


def lag_aligned(features: DataFrame, source: DataFrame, keys: Sequence[str],
                names: Mapping[str, str], days: Sequence[int], tolerance: float = 0.0) -> DataFrame:
    """Recompute every lag by shifted-date joins and count disagreements."""
    cols = [f"{stem}_lag_{k}d" for k in days for stem in names.values()]
    again = lag_days_by_join(source.select(*keys, "date", *names), keys, names, days)
    return compared(features, again, [*keys, "date"], cols, tolerance)


def target_aligned(features: DataFrame, source: DataFrame, keys: Sequence[str],
                   cols: Sequence[str], days: Sequence[int], label: str | None = None,
                   threshold: float = 2.0, tolerance: float = 0.0) -> DataFrame:
    """The same for leads, and for a label derived from the first of them."""
    base = source.select(*keys, "date", *cols)
    again = base.select(*keys, "date")
    for h in days:
        later = base.select(*keys, F.date_sub("date", h).alias("date"),
                            *[F.col(c).alias(f"{c}_t_plus_{h}d") for c in cols])
        again = again.join(later, [*keys, "date"], "left")
    names = [f"{c}_t_plus_{h}d" for h in days for c in cols]
    if label:
        again = again.withColumn(label, (F.col(names[0]) > threshold).cast("int"))
        names.append(label)
    return compared(features, again, [*keys, "date"], names, tolerance)


def compared(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str],
             tolerance: float) -> DataFrame:
    """Values of ``a`` against ``b`` at a's keys; one check per column."""
    right = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols])
    j = a.select(*keys, *cols).join(right, list(keys), "left")
    one = j.agg(*[F.count_if(~close_to(c, f"_b_{c}", tolerance)).alias(c) for c in cols])
    return zero(one, cols)


def no_leakage(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Feature names look backwards, are distinct, exclude targets; and no feature
    column equals a target row for row."""
    future = [c for c in features if "_t_plus_" in c or c.startswith("target")]
    pairs = [(f, t) for f in features for t in targets if f != t]
    one = df.agg(*[F.count_if(~F.col(f).cast("double").eqNullSafe(F.col(t).cast("double")))
                   .alias(f"d{i}") for i, (f, t) in enumerate(pairs)])
    rows = [("no_future_names", F.lit(not future), F.lit(len(future))),
            ("distinct_names", F.lit(len(set(features)) == len(features)),
             F.lit(len(features) - len(set(features)))),
            ("targets_excluded", F.lit(not set(features) & set(targets)),
             F.lit(len(set(features) & set(targets))))]
    rows += [(f"{f}_is_not_{t}", F.col(f"d{i}") > 0, F.col(f"d{i}")) for i, (f, t) in enumerate(pairs)]
    return checks(one, rows)


def season_boundary(df: DataFrame, keys: Sequence[str], names: Mapping[str, str],
                    lags: Sequence[int], leads: Mapping[str, Sequence[int]],
                    season: Season = AUTUMN) -> DataFrame:
    """No lag or lead is known when its source date lies outside the row's season."""
    aggs, order = [], []
    def outside(days: int) -> Column:
        src = F.date_add("date", days)
        return ~in_season(src, None, season) | (F.year(src) != F.year("date"))
    for stem in names.values():
        for k in lags:
            c = f"{stem}_lag_{k}d"
            aggs.append(F.count_if(outside(-k) & F.col(c).isNotNull()).alias(c))
            order.append(c)
    for col, hs in leads.items():
        for h in hs:
            c = f"{col}_t_plus_{h}d"
            aggs.append(F.count_if(outside(h) & F.col(c).isNotNull()).alias(c))
            order.append(c)
    return zero(df.agg(*aggs), order)


def key_consistency(df: DataFrame, source: DataFrame, keys: Sequence[str], entity: str = "entity",
                    region: str = "region") -> DataFrame:
    """All keys occur in the source; each entity lies in one region."""
    lost = df.select(*keys).distinct().join(source.select(*keys), list(keys), "left_anti").agg(
        F.count(F.lit(1)).alias("keys_missing_in_source"))
    many = A.having_more_than(df, [entity], region).agg(
        F.count(F.lit(1)).alias("entities_in_many_regions"))
    return all_checks(zero(lost, ["keys_missing_in_source"]), zero(many, ["entities_in_many_regions"]))


def coverage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every entity-year is free of gaps and all entities of a year have equal rows."""
    gaps = A.coverage_gaps(df, keys).agg(
        F.coalesce(F.sum(F.col("missing_days").cast("bigint")), F.lit(0)).alias("missing_days"))
    uneven = A.equal_coverage(df, keys).agg(
        F.count_if(F.col("distinct_counts") > 1).alias("years_with_unequal_rows"))
    return all_checks(zero(gaps, ["missing_days"]), zero(uneven, ["years_with_unequal_rows"]))


def distribution(df: DataFrame, stem: str, horizons: Sequence[int], threshold: float = 2.0) -> DataFrame:
    """Targets are never negative and every horizon has positives."""
    cols = [f"{stem}_t_plus_{h}d" for h in horizons]
    one = df.agg(*[F.count_if(F.col(c) < 0).alias(f"neg_{c}") for c in cols],
                 *[F.count_if(F.col(c) > threshold).alias(f"pos_{c}") for c in cols])
    return checks(one, [(f"{c}_not_negative", F.col(f"neg_{c}") == 0, F.col(f"neg_{c}")) for c in cols]
                  + [(f"{c}_has_positives", F.col(f"pos_{c}") > 0, F.col(f"pos_{c}")) for c in cols])


def metrics_finite(metrics: DataFrame, cols: Sequence[str]) -> DataFrame:
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in cols]
    return zero(metrics.agg(*bad), cols)


def tables_equal_except(a: DataFrame, b: DataFrame, keys: Sequence[str], except_cols: Sequence[str],
                        tolerance: float = 0.0) -> DataFrame:
    """Same columns in the same order, same keys, equal values outside ``except_cols``."""
    cols = [c for c in a.columns if c not in keys and c not in except_cols and c in b.columns]
    cmp = compare_columns(a, b, keys, cols, tolerance)
    head = cmp.agg(F.max("unmatched").alias("unmatched_keys"))
    shape = checks(head, [("same_columns", F.lit(a.columns == b.columns), F.lit(len(b.columns))),
                          ("same_keys", F.col("unmatched_keys") == 0, F.col("unmatched_keys"))])
    each = cmp.select(F.col("column").alias("name"),
                      ((F.col("different") == 0) & (F.col("null_pattern") == 0)).alias("passed"),
                      F.concat_ws("/", F.col("different").cast("string"),
                                  F.col("null_pattern").cast("string")).alias("detail"))
    return shape.unionByName(each)


def reconstruct(df: DataFrame, formulas: Mapping[str, Column], tolerance: float = 1e-12) -> DataFrame:
    """Derived columns equal their formula recomputed from the sources."""
    one = df.agg(*[F.count_if(~close_to(F.col(c), f, tolerance)).alias(c) for c, f in formulas.items()])
    return zero(one, list(formulas))


def numbers_match(expected: DataFrame, actual: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """(check, expected, actual, status): PASS, MISMATCH, MISSING, or INFO where
    nothing is expected."""
    j = expected.select("check", "expected").join(actual.select("check", "actual"), "check", "left")
    e, a = F.col("expected"), F.col("actual")
    return j.withColumn("status", F.when(e.isNull(), "INFO").when(a.isNull(), "MISSING")
                        .when(F.abs(a - e) <= tolerance, "PASS").otherwise("MISMATCH"))


def manifest_valid(manifest: DataFrame, keys: Sequence[str] = ("date", "region", "entity"),
                   identity: Sequence[str] = ("region", "entity", "source", "evidence_file"),
                   states: Sequence[str] = COVERAGE_STATES) -> DataFrame:
    """Dates, states, blanks and repeated keys of a coverage manifest."""
    m = manifest.fillna("", subset=list(identity) + ["observation_status"])
    blank = reduce(lambda x, y: x | y, [F.trim(c) == "" for c in identity])
    one = m.agg(F.count_if(F.col("date").try_cast("date").isNull()).alias("invalid_dates"),
                F.count_if(~F.col("observation_status").isin(*states)).alias("invalid_states"),
                F.count_if(blank).alias("blank_identity"))
    dup = m.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_x")).agg(
        F.coalesce(F.sum("_x"), F.lit(0)).alias("duplicate_keys"))
    return all_checks(zero(one, ["invalid_dates", "invalid_states", "blank_identity"]),
                      zero(dup, ["duplicate_keys"]))


def coverage_evidence(detections: DataFrame, manifest: DataFrame, features: DataFrame) -> DataFrame:
    """What is known about coverage: three small aggregates, one row each."""
    cols = ("evidence", "rows", "entities", "regions", "first_date", "last_date", "confirmed")
    none = lambda t: F.lit(None).cast(t)
    d = detections.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entity").alias("entities"),
                       F.count_distinct("region").alias("regions"), F.min("date").alias("first_date"),
                       F.max("date").alias("last_date")).withColumns(
        {"evidence": F.lit("detections"), "confirmed": none("bigint")})
    m = manifest.agg(F.count(F.lit(1)).alias("rows"),
                     F.count_if(F.col("status") == "SUCCESS").alias("confirmed")).withColumns(
        {"evidence": F.lit("manifest"), "entities": none("bigint"), "regions": none("bigint"),
         "first_date": none("date"), "last_date": none("date")})
    f = features.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entity").alias("entities"),
                     F.count_distinct("region").alias("regions"), F.min("date").alias("first_date"),
                     F.max("date").alias("last_date"),
                     F.count_if("ready").alias("confirmed")).withColumn("evidence", F.lit("features"))
    return S.union(*[x.select(*cols) for x in (d, m, f)])


def conservation(stages: Mapping[str, DataFrame], value: Mapping[str, str],
                 tolerance: float = 1e-6) -> DataFrame:
    """Totals of every stage equal the first stage's."""
    names = list(stages)
    first = stages[names[0]].agg(F.sum(value[names[0]]).cast("double")).scalar()
    out = [stages[n].agg(F.sum(value[n]).cast("double").alias("t")).select(
        F.lit(n).alias("name"), close_to(F.col("t"), first, tolerance).alias("passed"),
        F.round("t", 6).cast("string").alias("detail")) for n in names[1:]]
    return all_checks(*out)


def weights_sum_to_one(weights: DataFrame, keys: Sequence[str], weight: str = "area_weight",
                       tolerance: float = 1e-10) -> DataFrame:
    per = weights.groupBy(*keys).agg(F.abs(F.sum(weight) - 1).alias("_e"))
    return zero(per.agg(F.count_if(F.col("_e") > tolerance).alias("weights_off_one")), ["weights_off_one"])


def null_only_when(df: DataFrame, cols: Sequence[str], allowed: Column) -> DataFrame:
    """Columns are NULL only on rows where ``allowed`` holds."""
    return zero(df.agg(*[F.count_if(F.col(c).isNull() & ~allowed).alias(c) for c in cols]), cols)


def complete_panel(panel: DataFrame, keys: Sequence[str], date_col: str = "date") -> DataFrame:
    """Rows = entities x dates, with no key twice."""
    per_key = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = per_key.agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("rows"))
    dates = panel.agg(F.count_distinct(date_col)).scalar()
    one = totals.withColumn("expected", F.col("entities") * dates)
    full = checks(one, [("complete_panel", F.col("rows") == F.col("expected"),
                         F.col("rows") - F.col("expected"))])
    return full.unionByName(unique_key(panel, [*keys, date_col]))


def implementations_agree(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str,
                          tolerance: float = 1e-6) -> DataFrame:
    """Two implementations give the same keys and values."""
    one = reconcile(a, b, keys, value)
    return checks(one, [("keys_left_only", F.col("left_only") == 0, F.col("left_only")),
                        ("keys_right_only", F.col("right_only") == 0, F.col("right_only")),
                        ("values_equal", F.coalesce(F.col("max_abs_difference") <= tolerance,
                                                    F.lit(True)),
                         F.round("max_abs_difference", 9))])


def target_same(a: DataFrame, b: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Two arms are scored on identical targets."""
    cmp = compare_columns(a, b, keys, [target], 0.0)
    return checks(cmp, [("same_rows", F.col("unmatched") == 0, F.col("unmatched")),
                        ("same_targets", F.col("different") == 0, F.col("different"))])
