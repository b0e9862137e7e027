"""Calendar windows, month differences, day parts and week days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_PARTS = {"night": (0, 6), "morning": (7, 12), "afternoon": (13, 18), "evening": (19, 23)}
WEEK_DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def last_year_start(as_of: dt.date) -> dt.date:
    return dt.date(as_of.year - 1, 1, 1)


def months_back_start(as_of: dt.date, months: int) -> dt.date:
    index = as_of.year * 12 + as_of.month - 1 - months
    return dt.date(index // 12, index % 12 + 1, 1)


def days_back(as_of: dt.date, days: int) -> dt.date:
    return as_of - dt.timedelta(days=days)


def _moment(day: dt.date) -> Column:
    return F.lit(dt.datetime(day.year, day.month, day.day)).cast("timestamp_ntz")


def between_days(t: Column, start: dt.date, end: dt.date, inclusive_end: bool = True) -> Column:
    """``start`` <= t up to the whole of day ``end``.

    With ``inclusive_end=False`` the bound is the first instant of day ``end``, as a
    comparison of the raw timestamp with a date gives. The bounds are literals next
    to the bare column, so they reach the file scan.
    """
    if inclusive_end:
        return (t >= _moment(start)) & (t < _moment(end + dt.timedelta(days=1)))
    return (t >= _moment(start)) & (t <= _moment(end))


def since_last_year(t: Column, as_of: dt.date) -> Column:
    return between_days(t, last_year_start(as_of), as_of)


def since_months(t: Column, as_of: dt.date, months: int) -> Column:
    return between_days(t, months_back_start(as_of, months), as_of)


def since_days(t: Column, as_of: dt.date, days: int) -> Column:
    return between_days(t, days_back(as_of, days), as_of)


def _forward_months(a: Column, b: Column) -> Column:
    whole = (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))
    due = F.least(F.dayofmonth(a), F.dayofmonth(F.last_day(b)))
    earlier = (F.dayofmonth(b) < due) | ((F.dayofmonth(b) == due) & (_clock(b) < _clock(a)))
    return whole - F.when(earlier, 1).otherwise(0)


def _clock(t: Column) -> Column:
    at = t.cast("timestamp_ntz")
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.date_part(F.lit("SECOND"), at)


def full_months(a: Column, b: Column) -> Column:
    """Completed calendar months from ``a`` to ``b``; a short month's last day completes one, from the start's time of day."""
    return F.when(b >= a, _forward_months(a, b)).otherwise(-_forward_months(b, a))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(F.to_date(b), F.to_date(a))


def week_day(t: Column, style: str = "sunday") -> Column:
    """Day number: ``sunday`` counts 1 = Sunday, ``iso`` counts 1 = Monday."""
    if style == "sunday":
        return F.dayofweek(t)
    if style == "iso":
        return F.weekday(t) + 1
    raise ValueError(f"unknown week style {style!r}")


def day_part(t: Column) -> Column:
    out = None
    for name, (lo, hi) in DAY_PARTS.items():
        test = F.hour(t).between(lo, hi)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out
