"""Zone-free calendar expressions.

Everything stays on ``date`` / ``timestamp_ntz``: ``date_trunc`` and
``unix_micros`` are avoided because they go through the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from climatrix.schema import FREQUENCIES

EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


def calendar_columns(ts: Column) -> dict[str, Column]:
    """year, month, day, day of year and ISO week of a date or timestamp."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_of_year": F.dayofyear(ts),
        "week": F.weekofyear(ts),
    }


def period_label(ts: Column, freq: str) -> Column:
    """Label of the resample bucket holding ``ts``, as a date.

    D = the day; W = the Sunday ending the Monday-Sunday week; M, Q, Y = the
    last day of the month, quarter or year.
    """
    d = F.to_date(ts)
    if freq == "D":
        return d
    if freq == "W":
        return F.date_add(d, F.lit(6) - F.weekday(d))
    if freq == "M":
        return F.last_day(d)
    if freq == "Q":
        return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    if freq == "Y":
        return F.make_date(F.year(d), F.lit(12), F.lit(31))
    raise ValueError(f"frequency must be one of {FREQUENCIES}, got {freq!r}")


def period_calendar(first: Column, last: Column, freq: str) -> Column:
    """Array of every bucket label from ``first`` to ``last`` (both labels)."""
    if freq == "D":
        return F.sequence(first, last, F.expr("interval 1 day"))
    if freq == "W":
        return F.sequence(first, last, F.expr("interval 7 days"))
    if freq in ("M", "Q"):
        step = 1 if freq == "M" else 3
        starts = F.sequence(
            F.trunc(first, "month" if freq == "M" else "quarter"),
            F.trunc(last, "month" if freq == "M" else "quarter"),
            F.expr(f"interval {step} months"),
        )
        back = 0 if freq == "M" else 2
        return F.transform(starts, lambda s: F.last_day(F.add_months(s, back)))
    if freq == "Y":
        return F.transform(
            F.sequence(F.year(first), F.year(last)),
            lambda y: F.make_date(y, F.lit(12), F.lit(31)),
        )
    raise ValueError(f"frequency must be one of {FREQUENCIES}, got {freq!r}")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), ts)
