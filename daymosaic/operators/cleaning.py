"""Parsing, filtering, validating and de-duplicating rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymosaic.functions.numeric import nan_to_null, numeric_or_null
from daymosaic.functions.text import strip


class MissingColumns(ValueError):
    """Raised before a job starts when an input lacks columns."""


def require_columns(df: DataFrame, cols: Sequence[str], label: str = "input") -> DataFrame:
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise MissingColumns(f"{label} lacks columns: {', '.join(sorted(absent))}")
    return df


def parse_date(df: DataFrame, col: str, out: str = "date", keep_bad: bool = False) -> DataFrame:
    """Lenient date parse; unparseable rows are dropped unless kept as NULL."""
    df = df.withColumn(out, F.col(col).try_cast("date"))
    return df if keep_bad else df.filter(F.col(out).isNotNull())


def parse_numbers(df: DataFrame, cols: Sequence[str], floor: float | None = None) -> DataFrame:
    """Lenient numbers; with a floor, sentinels at or below it become NULL too."""
    return df.withColumns({c: numeric_or_null(c, floor) for c in cols})


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def norm_keys(df: DataFrame, cols: Sequence[str], case: str = "upper") -> DataFrame:
    change = {"upper": F.upper, "lower": F.lower, "keep": lambda c: c}[case]
    return df.withColumns({c: change(strip(F.col(c).cast("string"))) for c in cols})


def range_check(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One pass over the data; one row per rule with the number of violations.

    A rule is a boolean that holds for good rows; NULL counts as a violation.
    """
    aggs = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}")
            for i, rule in enumerate(rules.values())]
    one = df.agg(F.count(F.lit(1)).alias("checked"), *aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
                     for i, name in enumerate(rules)])
    return (one.select("checked", F.explode(rows).alias("r"))
            .select("r.rule", "checked", "r.violations",
                    (F.col("r.violations") == 0).alias("passed")))


def finite(c: str) -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def event_id(*natural_key: str) -> Column:
    """Surrogate id that depends on the row alone, so no global sort is needed."""
    return F.xxhash64(*natural_key)


def dedup_events(df: DataFrame, keys: Sequence[str],
                 prefer: Sequence[Column] | None = None) -> DataFrame:
    """One row per natural key.

    With ``prefer`` the survivor is the first by that order; the whole row goes
    through a max/min aggregate, so a hot key is combined before the shuffle
    and never gathered in one task.
    """
    if prefer is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prefer)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def dedup_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before, rows after and rows removed."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
                       F.count(F.lit(1)).alias("rows_after"),
                       F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))


def flags(df: DataFrame, confidence: str, daynight: str, high: Sequence[str] = ("h",),
          day: Sequence[str] = ("D",), night: Sequence[str] = ("N",)) -> DataFrame:
    return df.withColumns({
        "is_high": F.col(confidence).isin(*high),
        "is_day": F.col(daynight).isin(*day),
        "is_night": F.col(daynight).isin(*night),
    })


def scale(df: DataFrame, factors: Mapping[str, float], digits: int | None = None) -> DataFrame:
    def one(c: str, k: float) -> Column:
        x = F.col(c) * F.lit(float(k))
        return x if digits is None else F.round(x, digits)
    return df.withColumns({c: one(c, k) for c, k in factors.items()})


# Fixed value: 10 m wind to 2 m wind.
WIND_10M_TO_2M = 0.748


def search(df: DataFrame, text: str, cols: Sequence[str], exact: bool = False) -> DataFrame:
    """Case-insensitive equality or substring over any of the columns."""
    wanted = F.lower(strip(F.lit(text)))
    hit = F.lit(False)
    for c in cols:
        value = F.lower(strip(F.col(c)))
        hit = hit | ((value == wanted) if exact else value.contains(wanted))
    return df.filter(hit)


def to_records(df: DataFrame) -> DataFrame:
    """Dates as ISO strings and NaN as NULL: the shape an API hands out."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("date", "timestamp"):
            out.append(F.date_format(field.name, "yyyy-MM-dd").alias(field.name))
        elif kind in ("double", "float"):
            out.append(nan_to_null(field.name).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def select_features(df: DataFrame, exclude: Sequence[str],
                    exclude_matching: Sequence[str] = ("_t_plus_", "target_")) -> list[str]:
    """Column names left when keys, future values and targets are taken out."""
    return [c for c in df.columns
            if c not in exclude and not any(m in c for m in exclude_matching)]


def latest(df: DataFrame, date_col: str) -> DataFrame:
    """Rows at the newest date; the maximum is a scalar subquery, not a collect."""
    return df.filter(F.col(date_col) == df.agg(F.max(date_col)).scalar())
