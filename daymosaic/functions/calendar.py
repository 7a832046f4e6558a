"""Date expressions. Every function returns a Column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Season:
    """A yearly window, both ends included."""

    start_month: int = 10
    start_day: int = 1
    end_month: int = 11
    end_day: int = 30

    def span(self, year: int) -> tuple[date, date]:
        return (date(year, self.start_month, self.start_day),
                date(year, self.end_month, self.end_day))


AUTUMN = Season()


def day_index(d: Column | str) -> Column:
    """Days since 1970-01-01: the integer the range frames are ordered by."""
    return F.unix_date(F.col(d) if isinstance(d, str) else d)


def season_dates(years: Sequence[int], season: Season = AUTUMN) -> Column:
    """Array literal of every date of the seasons, oldest first."""
    spans = [season.span(y) for y in sorted(years)]
    return F.flatten(F.array(*[F.sequence(F.lit(a), F.lit(b)) for a, b in spans]))


def date_span(start: date, end: date) -> Column:
    """Array literal of every date from start to end."""
    return F.sequence(F.lit(start), F.lit(end))


def in_season(d: Column | str, years: Sequence[int] | None = None,
              season: Season = AUTUMN) -> Column:
    """True inside the season; with years, only in those seasons.

    With ``years`` the test is a chain of plain BETWEENs, which the Parquet
    scan can use to skip row groups.
    """
    d = F.col(d) if isinstance(d, str) else d
    if years is not None:
        hit = F.lit(False)
        for y in sorted(years):
            a, b = season.span(y)
            hit = hit | d.between(F.lit(a), F.lit(b))
        return hit
    mmdd = F.month(d) * 100 + F.dayofmonth(d)
    return mmdd.between(season.start_month * 100 + season.start_day,
                        season.end_month * 100 + season.end_day)


def day_of_season(d: Column | str, season: Season = AUTUMN) -> Column:
    """1 on the first season day; zero or less before it."""
    d = F.col(d) if isinstance(d, str) else d
    first = F.make_date(F.year(d), F.lit(season.start_month), F.lit(season.start_day))
    return F.datediff(d, first) + 1


def with_date_parts(df: DataFrame, date_col: str = "date", season: Season = AUTUMN) -> DataFrame:
    """Add year, month, day and day_of_season."""
    return df.withColumns({
        "year": F.year(date_col),
        "month": F.month(date_col),
        "day": F.dayofmonth(date_col),
        "day_of_season": day_of_season(date_col, season),
    })


def cycle(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle of the given length."""
    angle = F.lit(2.0) * F.pi() * x / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def horizon_days(c: Column | str) -> Column:
    """The number inside a horizon label: '+7d' gives 7."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def horizon_label(days: Column) -> Column:
    return F.concat(F.lit("+"), days.cast("string"), F.lit("d"))
