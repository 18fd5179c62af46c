"""Row-level expressions: geography, calendar flags, clipping, recoding."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import col, day

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in km; the root's argument is clamped against rounding."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat, half_lng = (p2 - p1) / 2, (F.radians(col(lng2)) - F.radians(col(lng1))) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lng), 2)
    chord = F.when(chord.isNotNull(), F.least(chord, F.lit(1.0)))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(chord))


def iso_weekday(c) -> Column:
    return F.weekday(day(c)) + 1


def iso_week_capped(c) -> Column:
    return F.least(F.weekofyear(day(c)), F.lit(52))


def flag(cond: Column) -> Column:
    return F.coalesce(cond.cast("int"), F.lit(0))


def keep_top(c, keep: Sequence, other: str = "Others") -> Column:
    c = col(c)
    return F.when(c.isin(list(keep)), c).otherwise(F.lit(other))


def recode(c, mapping: Mapping, default=None) -> Column:
    """Dictionary lookup; unlisted values become ``default``."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.create_map(*pairs)[col(c)]
    return found if default is None else F.coalesce(found, F.lit(default))


def route_label(origin, destination) -> Column:
    return F.concat_ws(" → ", F.coalesce(col(origin).cast("string"), F.lit("")),
                       F.coalesce(col(destination).cast("string"), F.lit("")))


def strip_order_prefix(c) -> Column:
    return F.regexp_replace(col(c), r"^\d+\.\s*", "")


def clip_to_waiting_period(pred, promised, waiting_period: int) -> Column:
    """Limit predicted days to lead times in ``[0, waiting_period]``; untouched without a promise."""
    pred, promised = col(pred), col(promised)
    clipped = F.greatest(F.least(pred, F.lit(waiting_period) - promised), -promised)
    return F.when(promised.isNull() | pred.isNull(), pred).otherwise(clipped)


def split_prediction(days) -> tuple[Column, Column]:
    """(late_by, early_by)."""
    days = col(days)
    zero = F.lit(0.0)
    return (F.when(days.isNotNull(), F.greatest(days, zero)),
            F.when(days.isNotNull(), F.greatest(-days, zero)))


def cyclic(c, period: int) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * col(c).cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def log1p_checked(c) -> Column:
    """log1p that fails the job on a negative input."""
    c = col(c).cast("double")
    return F.when(c < 0, F.raise_error(F.lit("log1p needs non-negative values"))
                  .cast("double")).otherwise(F.log1p(c))
