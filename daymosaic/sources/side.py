"""Daily side series ("weather") from nested payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.functions.numeric import numeric_or_null

# Fixed value: readings at or below this are sentinels for "missing".
SENTINEL_FLOOR = -900.0


def parse_parameter_maps(bodies: DataFrame, params: Sequence[str],
                         date_format: str = "yyyyMMdd") -> DataFrame:
    """Rows (source, date, params...) from parameter -> date -> value maps.

    Bodies whose parameters do not all carry the same dates are left out;
    ``map_rejects`` lists them. A value that is no number becomes NULL.
    """
    ok = _maps(bodies, params).filter("same_dates")
    days = ok.select("source", "m", F.explode(F.map_keys(F.element_at("m", params[0]))).alias("k"))
    return days.select(
        "source", F.to_date(F.try_to_timestamp("k", F.lit(date_format))).alias("date"),
        *[numeric_or_null(F.try_element_at(F.try_element_at(F.col("m"), F.lit(p)), F.col("k")),
                          SENTINEL_FLOOR).alias(p) for p in params])


def _maps(bodies: DataFrame, params: Sequence[str]) -> DataFrame:
    m = F.from_json("body", "struct<properties:struct<parameter:map<string,map<string,string>>>>")
    df = bodies.select("source", m["properties"]["parameter"].alias("m"))
    first = F.map_keys(F.try_element_at(F.col("m"), F.lit(params[0])))
    same = F.col("m").isNotNull()
    for p in params:
        keys = F.map_keys(F.try_element_at(F.col("m"), F.lit(p)))
        same = same & keys.isNotNull() & (F.size(F.array_except(first, keys)) == 0) & (
            F.size(F.array_except(keys, first)) == 0)
    return df.withColumn("same_dates", F.coalesce(same, F.lit(False)))


def map_rejects(bodies: DataFrame, params: Sequence[str]) -> DataFrame:
    return _maps(bodies, params).filter("not same_dates").select("source")


def parse_parallel_arrays(bodies: DataFrame, fields: Mapping[str, str], time_field: str = "time",
                          root: str = "daily", days: int = 3) -> DataFrame:
    """Rows from a struct of parallel arrays; ``fields`` maps input to output names.

    Kept are bodies with exactly ``days`` dates, arrays of that length, and no
    NULL values. ``array_rejects`` lists the others.
    """
    ok = _arrays(bodies, list(fields), time_field, root, days).filter("complete")
    rows = ok.select("source", F.explode(F.arrays_zip(
        *[F.col(f"r.{c}").alias(c) for c in (time_field, *fields)])).alias("z"))
    return rows.select("source", F.col(f"z.{time_field}").try_cast("date").alias("date"),
                       *[F.col(f"z.{c}").alias(out) for c, out in fields.items()])


def _arrays(bodies, fields, time_field, root, days) -> DataFrame:
    inner = ", ".join([f"{time_field}: array<string>", *[f"{f}: array<double>" for f in fields]])
    j = F.from_json("body", f"struct<{root}: struct<{inner}>>")
    df = bodies.select("source", j[root].alias("r"))
    ok = F.col("r").isNotNull()
    for f in (time_field, *fields):
        a = F.col(f"r.{f}")
        ok = ok & a.isNotNull() & (F.size(a) == days) & F.forall(a, lambda v: v.isNotNull())
    return df.withColumn("complete", F.coalesce(ok, F.lit(False)))


def array_rejects(bodies: DataFrame, fields: Mapping[str, str], time_field: str = "time",
                  root: str = "daily", days: int = 3) -> DataFrame:
    return _arrays(bodies, list(fields), time_field, root, days).filter("not complete").select("source")
