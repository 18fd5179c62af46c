"""Missing-value rules that differ from plain SQL comparisons."""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import col


def differs(a, b) -> Column:
    """Unequal, where a missing side always counts as different (even on both sides)."""
    return F.coalesce(col(a) != col(b), F.lit(True))


def holds(cond: Column) -> Column:
    """A comparison with a missing side is false."""
    return F.coalesce(cond, F.lit(False))


def n_rows(name: str = "n") -> Column:
    """Row count of a group."""
    return F.count(F.lit(1)).alias(name)


def sum0(c) -> Column:
    """Sum that is 0 for a group whose values are all missing."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def count_where(cond: Column) -> Column:
    return F.count_if(holds(cond))


def ratio(a, b) -> Column:
    """a / b, missing when b is 0 or missing."""
    b = col(b)
    return col(a) / F.when(b != 0, b)


def percent(a, b) -> Column:
    return ratio(F.lit(100.0) * col(a), b)


def finite(c) -> Column:
    """The number, missing when it is NaN or infinite."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), col(c))


def join_groups(left, right, keys, how: str = "inner"):
    """Joins two tables of one row per group on null-safe keys; without keys, their single rows."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(and_, (left[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys), F.lit(True))
    return left.join(renamed, same, how).drop(*(f"_key_{k}" for k in keys))
