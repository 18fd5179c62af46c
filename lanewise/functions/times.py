"""Calendar-day and elapsed-time expressions over zone-free timestamps.

Three notions of "days" exist and are kept apart: differences of calendar dates,
floored elapsed days, and fractional elapsed days.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(c) -> Column:
    return col(c).cast("date")


def micros(c) -> Column:
    """Microseconds since the epoch without any zone conversion."""
    c = col(c)
    clock = F.hour(c) * 3600 + F.minute(c) * 60
    return (F.unix_date(c.cast("date")).cast("bigint") * DAY_MICROS
            + clock.cast("bigint") * 1_000_000
            + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint"))


def calendar_days(later, earlier) -> Column:
    return F.datediff(day(later), day(earlier))


def elapsed_days(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(DAY_MICROS))


def floored_days(later, earlier) -> Column:
    return F.floor(elapsed_days(later, earlier)).cast("int")


def elapsed_hours(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3_600_000_000.0)


def newest_days(before: dt.date, gap: int, length: int) -> tuple[dt.date, dt.date]:
    """First and last of the ``length`` days that end ``gap`` days before a date."""
    last = before - dt.timedelta(days=gap)
    return last - dt.timedelta(days=length - 1), last


def month_label(c) -> Column:
    return F.date_format(day(c), "yyyy-MM")


def month_start(c) -> Column:
    return F.trunc(day(c), "MM")


def month_bounds(month: str) -> tuple[Column, Column]:
    """First and last day of a ``YYYY-MM`` month."""
    first = F.to_date(F.lit(f"{month}-01"))
    return first, F.last_day(first)
