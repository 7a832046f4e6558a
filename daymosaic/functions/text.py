"""Key normalisation and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """Take blanks, tabs and line ends off both sides."""
    return F.trim(c, F.lit(" \t\r\n\f\v"))


def norm_upper(c: Column | str) -> Column:
    return F.upper(strip(c))


def norm_lower(c: Column | str) -> Column:
    return F.lower(strip(c))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def alias_value(c: str, names: Mapping[str, str]) -> Column:
    """Replace literal names; everything else stays."""
    out = F.col(c)
    if not names:
        return out
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, out), out)


def choose(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First matching case wins."""
    test, value = cases[0]
    out = F.when(test, value)
    for test, value in cases[1:]:
        out = out.when(test, value)
    return out.otherwise(default)


# Label names used in prediction and tracker tables.
ELEVATED, NORMAL, PENDING, CORRECT, INCORRECT = (
    "Elevated", "Normal", "Pending", "Correct", "Incorrect")
ERROR_NAMES = {"TP": "True Positive", "TN": "True Negative",
               "FP": "False Positive", "FN": "False Negative"}
REGIMES = ("No current activity", "Low current activity", "Elevated current activity")
RISK_BANDS = ((0.60, "Very high"), (0.40, "High"), (0.20, "Moderate"))
RISK_BAND_REST = "Low"


def risk_label(p: Column | str, threshold: float) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p >= threshold, ELEVATED).when(p.isNotNull(), NORMAL)


def risk_band(p: Column | str) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return choose([(p >= cut, name) for cut, name in RISK_BANDS]
                  + [(p.isNotNull(), RISK_BAND_REST)])


def confusion_cell(actual: str, predicted: str) -> Column:
    a, p = F.col(actual), F.col(predicted)
    return choose([((a == 1) & (p == 1), "TP"), ((a == 0) & (p == 0), "TN"),
                   ((a == 0) & (p == 1), "FP"), ((a == 1) & (p == 0), "FN")])


def transition(now: str, later: str) -> Column:
    """N->N, N->E, E->N or E->E from two 0/1 labels."""
    side = lambda c: F.when(F.col(c) == 1, "E").when(F.col(c) == 0, "N")
    return F.concat(side(now), F.lit("->"), side(later))


def regime(count: str, threshold: float = 2.0) -> Column:
    c = F.col(count)
    return choose([(c <= 0, REGIMES[0]), (c <= threshold, REGIMES[1]),
                   (c.isNotNull(), REGIMES[2])])
