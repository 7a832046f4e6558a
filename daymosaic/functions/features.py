"""Feature expressions over lag columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO_EPSILON = 1e-6


def row_mean(cols: Sequence[str], skip_null: bool) -> Column:
    """Mean across columns of one row.

    skip_null=True averages the values that are present (NULL when none is);
    skip_null=False is NULL as soon as one value is missing.
    """
    vals = [F.col(c).cast("double") for c in cols]
    if not skip_null:
        return reduce(add, vals) / F.lit(float(len(vals)))
    total = reduce(add, [F.coalesce(v, F.lit(0.0)) for v in vals])
    present = reduce(add, [v.isNotNull().cast("int") for v in vals])
    return F.when(present > 0, total / present)


def change(newer: str, older: str) -> Column:
    return F.col(newer) - F.col(older)


def recent_ratio(value: str, mean: str, eps: float = RATIO_EPSILON) -> Column:
    return F.col(value) / (F.col(mean) + F.lit(eps))


def slope(oldest_to_newest: Sequence[str]) -> Column:
    """Least-squares slope over equally spaced positions 0..n-1."""
    n = len(oldest_to_newest)
    centre = (n - 1) / 2.0
    denom = sum((i - centre) ** 2 for i in range(n))
    terms = [F.col(c) * F.lit(i - centre) for i, c in enumerate(oldest_to_newest)
             if i != centre]
    # the middle term has weight zero but still decides whether the slope is known
    middle = [F.col(c) for i, c in enumerate(oldest_to_newest) if i == centre]
    out = reduce(add, terms) / F.lit(denom)
    return F.when(middle[0].isNotNull(), out) if middle else out


def acceleration(lag1: str, lag2: str, lag3: str) -> Column:
    return (F.col(lag1) - F.col(lag2)) - (F.col(lag2) - F.col(lag3))


def interaction(own: str, neighbour: str) -> Column:
    return F.col(own) * F.col(neighbour)


def relative(neighbour: str, own: str) -> Column:
    return F.col(neighbour) / (F.col(own) + F.lit(1.0))


def share_or_zero(part: str, total: str) -> Column:
    return F.when(F.col(total) > 0, F.col(part) / F.col(total)).otherwise(F.lit(0.0))


def above(value: Column | str, threshold: float) -> Column:
    """Strict threshold label 1/0; NULL where the value is unknown."""
    v = F.col(value) if isinstance(value, str) else value
    return (v > threshold).cast("int")
