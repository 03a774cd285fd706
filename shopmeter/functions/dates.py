"""Calendar helpers: labels as columns, parameters validated on the driver."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# French month names, January first.
MONTH_NAMES = [
    "Janvier", "Février", "Mars", "Avril", "Mai", "Juin",
    "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre",
]


def parse_day(text: str | dt.date) -> dt.date:
    """A ``YYYY-MM-DD`` parameter as a date; ``ValueError`` on anything else."""
    if isinstance(text, dt.date):
        return text
    return dt.datetime.strptime(text, "%Y-%m-%d").date()


def weekday_name(day: Column) -> Column:
    """Monday .. Sunday; sort by :func:`weekday_rank`, not by the name."""
    return F.date_format(day, "EEEE")


def weekday_rank(day: Column) -> Column:
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def quarter_rank(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day)


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def month_name(month: Column) -> Column:
    """Month number to French month name; null outside 1..12."""
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.when(month.between(1, 12), F.get(names, month - 1))


def month_number(name: Column) -> Column:
    """French month name to month number; null for an unknown name."""
    names = F.array(*[F.lit(known) for known in MONTH_NAMES])
    position = F.array_position(names, name).cast("int")
    return F.when(position > 0, position)


def period_bounds(year: int, month: int | None = None) -> tuple[dt.date, dt.date]:
    """First day of the year or month, and first day after it."""
    if month is None:
        return dt.date(year, 1, 1), dt.date(year + 1, 1, 1)
    following = dt.date(year + month // 12, month % 12 + 1, 1)
    return dt.date(year, month, 1), following


def in_period(day: Column, year: int, month: int | None = None) -> Column:
    """A calendar filter written as a range, so date partitions prune."""
    first, after = period_bounds(year, month)
    return (day >= F.lit(first)) & (day < F.lit(after))


def previous_month(year: int, month: int) -> tuple[int, int]:
    return (year, month - 1) if month > 1 else (year - 1, 12)
