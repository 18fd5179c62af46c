"""Input contracts, drift flags and score context for scored rows."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import holds
from .features import NUMBER_KINDS
from .ordering import prefix_sums

# Calendar bounds and the magnitude ceiling of the contract.
CALENDAR_BOUNDS = {"order_approved_day_of_week": (1, 7), "order_approved_day_of_month": (1, 31),
                   "order_approved_month": (1, 12), "order_approved_week_of_year": (1, 53)}
MAGNITUDE_LIMIT = 1e12


def _fraction(c: str) -> Column:
    return F.col(c) != F.floor(c)


# Kind of number -> what breaks its rule.
BROKEN = {
    "negative": lambda c: F.col(c) < 0,
    "whole number": _fraction,
    "count": lambda c: (F.col(c) < 1) | _fraction(c),
    "count from zero": lambda c: (F.col(c) < 0) | _fraction(c),
    "calendar bound": lambda c: ~F.col(c).between(*CALENDAR_BOUNDS[c]) | _fraction(c),
    "flag": lambda c: ~F.col(c).isin(0, 1),
}
# Derived flags: both columns, and the value of the flag by the calendar.
DERIVED = {
    "is_weekend_approval": ("order_approved_day_of_week", "{c} >= 6"),
    "is_december_peak": ("order_approved_month", "{c} = 12"),
}
LAST_DAY = "day(last_day(make_date(2020, CAST(order_approved_month AS INT), 1)))"  # a leap year


def _number_rules(name: str) -> dict[str, Column]:
    kind, size = NUMBER_KINDS.get(name, "negative"), F.abs(F.col(name).cast("double"))
    return {f"{name}: not finite": F.isnan(size) | (size == float("inf")),
            f"{name}: magnitude": (size > MAGNITUDE_LIMIT) & (size < float("inf")),
            f"{name}: {kind.removesuffix(' from zero')}": BROKEN[kind](name)}


def require_features(given: Sequence[str], known: Sequence[str]) -> None:
    """Refuses inputs the contract does not name."""
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"unknown features: {unknown}")


def validate(df: DataFrame, numeric: Sequence[str], categories: Mapping[str, Sequence[str]], others: Sequence[str] | None = None) -> DataFrame:
    """Adds ``violations``: every broken rule of the row (missing numbers are allowed).

    With ``others``, the columns that rows may have beside the model's inputs, any further column is refused.
    """
    if others is not None:
        require_features(df.columns, [*numeric, *categories, *others])
    absent = {*numeric, *categories}.difference(df.columns)
    if absent:
        raise ValueError(f"missing required columns: {sorted(absent)}")
    broken = {rule: test for c in numeric for rule, test in _number_rules(c).items()}
    broken["all numeric missing"] = F.coalesce(*(F.col(c).cast("double") for c in numeric)).isNull()
    if {"order_approved_month", "order_approved_day_of_month"}.issubset(numeric):
        broken["day not in month"] = F.expr(f"CASE WHEN CAST(order_approved_month AS INT) IN ({', '.join(map(str, range(1, 13)))}) THEN order_approved_day_of_month > {LAST_DAY} "
                                            "ELSE order_approved_day_of_month > 31 END")
    for flag, (source, true_when) in DERIVED.items():
        if {flag, source}.issubset(numeric):
            broken[f"{flag}: inconsistent"] = F.expr(f"{flag} <> CAST({true_when.format(c=source)} AS INT)")
    broken |= {f"{c}: category": ~F.coalesce(F.col(c).isin(list(levels)), F.lit(False)) for c, levels in categories.items()}
    return df.withColumn("violations", F.array_compact(F.array(*(F.when(holds(b), F.lit(rule)) for rule, b in broken.items()))))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.size("violations") > 0
    return df.where(~bad).drop("violations"), df.where(bad)


def drift_flags(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Adds ``drifted``: inputs outside their reference range."""
    return df.withColumn("drifted", F.array_compact(F.array(*[
        F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(c)) for c, (lo, hi) in ranges.items()])))


def score_percentile(df: DataFrame, reference: DataFrame, score: str) -> DataFrame:
    """Share of reference scores strictly below each score.

    Distinct scores of both sides share one running count, then an equi join on the
    score; the count is never a range join.
    """
    ref = reference.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    asked = df.select(F.col(score).alias("_s")).where("_s IS NOT NULL").distinct().withColumn("_c", F.lit(0).cast("bigint"))
    steps = ref.unionByName(asked).groupBy("_s").agg(F.sum("_c").alias("_c"))
    run = prefix_sums(steps, [], [F.col("_s")], {"c": F.col("_c")})
    below = run.select("_s", ((F.col("cum_c") - F.col("_c")) / F.col("all_c")).alias("percentile"))
    return df.join(below, F.col(score) == F.col("_s"), "left").drop("_s")
