"""Safe arithmetic, clipping, binning and reproducible hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio_or_zero(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0.0 where b is zero."""
    return F.coalesce(_c(a).cast("double") / F.nullif(_c(b).cast("double"), F.lit(0.0)), F.lit(0.0))


def ratio_or_null(a: Column | str, b: Column | str) -> Column:
    """a / b, and NULL where b is zero."""
    return _c(a).cast("double") / F.nullif(_c(b).cast("double"), F.lit(0.0))


def clip(x: Column | str, low: float, high: float) -> Column:
    """Keep x inside [low, high]; NULL stays NULL."""
    x = _c(x)
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def close_to(a: Column | str, b: Column | str, tolerance: float = 0.0) -> Column:
    """Within tolerance, and true when both are NULL. Never NULL itself."""
    a, b = _c(a), _c(b)
    if tolerance == 0:
        return a.eqNullSafe(b)
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def nan_to_null(x: Column | str) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def equal_width_bin(p: Column | str, bins: int = 10, closed: str = "left") -> Column:
    """Bin number 0..bins-1 of a score in [0, 1]; NULL outside.

    closed='left' uses [lo, hi) with the last bin closed; closed='right' uses
    (lo, hi] with 0 in the first. Edges are k / bins, compared as doubles.
    """
    p = _c(p)
    guess = F.floor(p * bins).cast("int")
    edge = lambda k: k.cast("double") / F.lit(float(bins))
    if closed == "left":
        k = (F.when(p >= edge(guess + 1), guess + 1)
             .when(p < edge(guess), guess - 1).otherwise(guess))
    elif closed == "right":
        k = (F.when(p <= edge(guess), guess - 1)
             .when(p > edge(guess + 1), guess + 1).otherwise(guess))
    else:
        raise ValueError("closed must be 'left' or 'right'")
    k = F.greatest(F.lit(0), F.least(F.lit(bins - 1), k))
    return F.when(p.between(0.0, 1.0), k)


def label_bins(x: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins between the cuts: (-inf, c0], (c0, c1], ..., (cn, inf)."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("one label more than cuts is needed")
    x = _c(x)
    out = None
    for cut, label in zip(cuts, labels):
        test = x <= cut
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.when(x.isNotNull(), labels[-1])


def hash_uniform(*cols: Column | str) -> Column:
    """A reproducible draw from [0, 1) keyed by the given values.

    It is built from MD5, so any SQL engine can redo the same draw, and a
    re-run task draws the same number again.
    """
    text = F.concat_ws(":", *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def poisson_one_edges() -> list[tuple[int, float]]:
    """(k, P(weight <= k)) while a 52-bit draw can lie above."""
    edges, term, total = [], 0.36787944117144233, 0.0
    while total < 1.0 - 2.0 ** -52 and term > 2.0 ** -53:
        total += term
        edges.append((len(edges), total))
        term /= len(edges)
    return edges


def poisson_one(u: Column) -> Column:
    """Poisson(1) weight for a uniform draw, by the inverse distribution function.

    The chain goes on until what is left is below the draw's 52 bits. The draw is bound to a lambda variable, so that it is computed once and not
    again in every branch.
    """
    edges = poisson_one_edges()

    def weight(x: Column) -> Column:
        out = None
        for k, edge in edges:
            out = F.when(x < edge, k) if out is None else out.when(x < edge, k)
        return out.otherwise(len(edges))
    return F.get(F.transform(F.array(u), weight), F.lit(0))


def numeric_or_null(c: Column | str, floor: float | None = None) -> Column:
    """Lenient number; NULL for text, NaN and, with a floor, values at or below it."""
    x = _c(c).try_cast("double")
    x = F.when(~F.isnan(x), x)
    return x if floor is None else F.when(x > floor, x)
