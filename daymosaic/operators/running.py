"""Running totals over a sorted column without sorting a group in one task.

A plain window sum puts a whole group in one task. Here a monotone expression
maps the sorted axis to [0, 1), which is cut into 262,144 slots. Slot totals
are summed first (partial aggregation does most of that before any shuffle),
prefix sums run over the slots, a bounded number of rows per group, and only
rows inside the same slot are sorted together. A slot depends on the value
alone, so a recomputed task lands in the same slot. A group sorted downwards
is passed with a falling position expression.

Values crowded into few slots, as timestamps or ids of one magnitude, are
spread again: a slot of over CROWDED rows is cut between its own least and
largest position. The cuts are written down, so that retries agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.operators.joins import join_small
from daymosaic.session import materialise

SLOTS = 262_144
CROWDED, CUTS = 1024, 65_536


def logit_position(p: Column, descending: bool = False) -> Column:
    """Position of a probability. Resolves scores crowded near 0 or 1."""
    odds = p / (F.lit(1.0) - p)
    z = F.when(p <= 0, F.lit(-746.0)).when(p >= 1, F.lit(38.0)).otherwise(F.ln(odds))
    z = F.greatest(F.lit(-746.0), F.least(F.lit(38.0), z))
    # 7/8 of the axis to log-odds in [-14, 14]; the far tails share the rest
    body = (F.greatest(F.lit(-14.0), F.least(F.lit(14.0), z)) + 14.0) / 28.0
    low = (F.greatest(F.lit(-746.0), F.least(F.lit(-14.0), z)) + 746.0) / 732.0
    high = (F.greatest(F.lit(14.0), F.least(F.lit(38.0), z)) - 14.0) / 24.0
    pos = low / 16.0 + body * 0.875 + high / 16.0
    return F.lit(1.0) - pos if descending else pos


def log_position(x: Column, descending: bool = False) -> Column:
    """Position of any finite number by signed logarithm."""
    z = F.signum(x) * F.ln(F.lit(1.0) + F.abs(x))
    # magnitudes up to e^35 get 7/8 of the axis
    body = (F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z)) + 35.0) / 70.0
    low = (F.greatest(F.lit(-710.0), F.least(F.lit(-35.0), z)) + 710.0) / 675.0
    high = (F.greatest(F.lit(35.0), F.least(F.lit(710.0), z)) - 35.0) / 675.0
    pos = low / 16.0 + body * 0.875 + high / 16.0
    return F.lit(1.0) - pos if descending else pos


def running_totals(df: DataFrame, keys: Sequence[str], order: Column, position: Column,
                   sums: Sequence[str], refine: bool = False) -> DataFrame:
    """Add cum_<c> (up to and including the row) and total_<c> for each sum.

    ``df`` holds one row per (keys, sorted value). ``position`` must rise with
    ``order`` and lie in [0, 1]. With ``refine`` crowded slots are cut again;
    that reads ``df`` once more, so pass a stored table.
    """
    slot = F.least(F.floor(position * F.lit(float(SLOTS))).cast("bigint"), F.lit(SLOTS - 1))
    rows = df.withColumn("_slot", slot)
    by = list(keys)
    inner = ["_slot"]
    if refine:
        rows, inner = _cut_again(rows.withColumn("_pos", position), by), ["_slot", "_sub"]
    slots = rows.groupBy(*by, *inner).agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(*inner).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(
        *by, *inner, *[F.sum(f"_s_{c}").over(group).alias(f"total_{c}") for c in sums],
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = (Window.partitionBy(*by, *inner).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(slots, [*by, *inner]).withColumns(
        {f"cum_{c}": F.col(f"_b_{c}") + F.sum(c).over(inside) for c in sums}
    ).drop(*inner, "_pos", *[f"_b_{c}" for c in sums])


def _cut_again(rows: DataFrame, by: list[str]) -> DataFrame:
    """Add _sub, which rises with _pos inside a slot: 0 but in crowded slots."""
    n = F.count(F.lit(1))
    crowded = rows.groupBy(*by, "_slot").agg(n.alias("_n"), F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi")).filter(
        (F.col("_n") > CROWDED) & (F.col("_hi") > F.col("_lo")))
    cuts = F.least(F.ceil(F.col("_n") / F.lit(CROWDED // 4)), F.lit(CUTS)).cast("double")
    at = F.floor((F.col("_pos") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cuts)
    sub = F.coalesce(F.least(at, cuts - 1).cast("bigint"), F.lit(0))
    return join_small(rows, crowded, [*by, "_slot"]).withColumn("_sub", sub).drop("_n", "_lo", "_hi")


def percentiles(df: DataFrame, keys: Sequence[str], value: str,
                points: Sequence[float], prefix: str = "p") -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key.

    Equal values are counted first; the two ranks around each point are then
    picked from the running counts.
    """
    x = F.col(value).cast("double")
    counts = (df.filter(x.isNotNull()).groupBy(*keys, x.alias("_x"))
              .agg(F.count(F.lit(1)).alias("n")))
    run = running_totals(materialise(counts, "counts"), keys, F.col("_x"), log_position(F.col("_x")), ["n"], refine=True)
    lo_rank = F.col("cum_n") - F.col("n")
    aggs = []
    for i, p in enumerate(points):
        at = F.lit(float(p)) * (F.col("total_n") - 1)
        low, high = F.floor(at), F.ceil(at)
        has = lambda k: (lo_rank <= k) & (k < F.col("cum_n"))
        aggs += [F.max(F.when(has(low), F.col("_x"))).alias(f"_l{i}"),
                 F.max(F.when(has(high), F.col("_x"))).alias(f"_h{i}"),
                 F.max(at - low).alias(f"_f{i}")]
    out = run.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[
        (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}"))
        .alias(f"{prefix}{round(p * 100):02d}") for i, p in enumerate(points)])
