"""Chronological splits and expanding day-blocked folds as data.

A fold plan is a short list of dates; membership is a long table
``(fold, role, row...)`` produced by a generator over that list.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import day, newest_days
from .joins import param_rows
from .ordering import global_rank, hash_order

Audit = Callable[[DataFrame, Column], DataFrame]


def approval_days(df: DataFrame) -> list[dt.date]:
    """Distinct approval days; the calendar bounds the size of this list."""
    return sorted(r[0] for r in df.select(day("approved_at").alias("d")).where("d IS NOT NULL").distinct().collect())


def chronological_split(df: DataFrame, test_days: int = 30, gap_days: int = 0) -> DataFrame:
    """Adds ``split``: the newest days are 'test', days before the gap 'train', the gap is missing.

    Refused when a row has no approval day or either part would hold no day.
    """
    d = day("approved_at")
    first, last, undated = df.agg(F.min(d), F.max(d), F.count_if(d.isNull())).first()
    if undated:
        raise ValueError(f"{undated} rows without an approval day")
    test = newest_days(last, 0, test_days) if last else None
    before = test and test[0] - dt.timedelta(days=gap_days)
    _check_plan([{"train": (first, before), "gap": gap_days, "valid": test}] if last else [])
    return df.withColumn("split", F.when(d >= F.lit(test[0]), "test").when(d < F.lit(before), "train"))


def _check_plan(parts: Sequence[dict]) -> None:
    """A usable plan: at least one part, days to train on before the gap, validation days in order, and the gap kept."""
    problems = [
        "no approval days" if not parts else "",
        *("empty validation block" for p in parts if p["valid"][0] > p["valid"][1]),
        *("negative gap" for p in parts if p["gap"] < 0),
        *("no training day before the gap" for p in parts if p["train"][0] >= p["train"][1]),
        *("validation blocks overlap" for a, b in zip(parts, parts[1:]) if a["valid"][1] >= b["valid"][0])]
    if any(problems):
        raise ValueError("unusable split: " + "; ".join(sorted(set(filter(None, problems)))))


def available_training_rows(train: DataFrame, validation_start, audit: Audit, known_col: str,
                            y: str = "y") -> DataFrame:
    """Rows whose target was known at validation start and has not changed since."""
    seen = audit(train, F.lit(validation_start))
    return seen.where(F.col(known_col).cast("double") == F.col(y)).select(*train.columns)


def known_outcomes(rows: DataFrame, start, audit: Audit, known_col: str, name: str = "_seen") -> DataFrame:
    """Adds ``name``: the outcome of the row's order as known at ``start``; rows without an order are left out.

    An order that comes once knows its outcome by itself, and its row stays where it is. If any order comes in several rows, rows meet
    the outcomes of all rows of their order in a join.
    """
    run, rest = F.lit(start), [c for c in rows.columns if c != "order_id"]
    rows = rows.where("order_id IS NOT NULL")
    if rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
        return rows.join(audit(rows, run).select("order_id", F.col(known_col).alias(name)), "order_id")
    held = rows.withColumn("_row", F.struct(*rest))  # the audit's columns may have names of the rows
    return audit(held, run).select("order_id", "_row.*", F.col(known_col).alias(name))


def fold_plan(days: Sequence[dt.date], n_splits: int = 5, gap_days: int = 0, min_train_days: int | None = None,
              validation_days: int | None = None) -> list[dict]:
    """``{fold, valid_start, valid_end, train_before}`` per fold, oldest first.

    Blocks are fixed calendar lengths anchored at the newest day (``validation_days``),
    or near-equal runs of distinct days after an initial span.
    """
    if validation_days is not None and min_train_days is not None:
        raise ValueError("fixed-length blocks leave no choice of the initial span")
    one = dt.timedelta(days=1)
    if not days or n_splits < 2:
        blocks = []
    elif validation_days is not None:
        ends = [days[-1] - one * (validation_days * k) for k in reversed(range(n_splits))]
        blocks = [newest_days(end, 0, validation_days) for end in ends]
    else:
        initial = 0 if min_train_days is None else max(min_train_days, 1) + gap_days
        pool = [d for d in days if (d - days[0]).days >= initial]
        parts = n_splits + (min_train_days is None)
        runs = [pool[a:b] for a, b in _near_equal(len(pool), parts)][parts - n_splits:]
        blocks = [(run[0], run[-1]) for run in runs if run]
        if len(blocks) < n_splits:
            raise ValueError("unusable split: fewer days than folds")
    plan = [{"fold": i, "valid_start": lo, "valid_end": hi, "train_before": lo - one * gap_days} for i, (lo, hi) in enumerate(blocks, 1)]
    _check_plan([{"train": (days[0], p["train_before"]), "gap": gap_days, "valid": (p["valid_start"], p["valid_end"])} for p in plan])
    if any(not any(p["valid_start"] <= d <= p["valid_end"] for d in days) for p in plan):
        raise ValueError("unusable split: a validation block without approvals")
    return plan


def _near_equal(n: int, parts: int) -> list[tuple[int, int]]:
    """Bounds of ``parts`` runs of ``n`` items, the longer ones first."""
    long, size = n % parts, n // parts
    at = [k * size + min(k, long) for k in range(parts + 1)]
    return list(zip(at, at[1:]))


def assign_folds(df: DataFrame, plan: Sequence[dict]) -> DataFrame:
    """Long fold table: every row once per fold it trains or validates in."""
    d = day("approved_at")
    member = F.filter(param_rows(plan), lambda p: (d < p["train_before"]) | d.between(p["valid_start"], p["valid_end"]))
    return (df.withColumn("_p", F.explode(member))
            .select(*df.columns, "_p.fold", "_p.valid_start",
                    F.when(d < F.col("_p.train_before"), "train").otherwise("valid").alias("role")))


def day_blocked_folds(df: DataFrame, **settings) -> DataFrame:
    return assign_folds(df, fold_plan(approval_days(df), **settings))


def available_outcome_folds(folds: DataFrame, audit: Audit, known_col: str, y: str = "y") -> DataFrame:
    """Drops training rows not yet known at the first observed validation day of their fold."""
    starts = (folds.where("role = 'valid'").groupBy("fold").agg(F.min(day("approved_at")).alias("_start")))
    seen = audit(folds.join(F.broadcast(starts), "fold"), F.col("_start"))
    keep = (F.col("role") == "valid") | (F.col(known_col).cast("double") == F.col(y))
    return seen.where(keep).select(*folds.columns)


def fold_summary(folds: DataFrame, y: str = "y") -> DataFrame:
    return folds.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min(day("approved_at")).alias("first_day"),
        F.max(day("approved_at")).alias("last_day"), F.avg(y).alias("mean_y"))


def stratified_split(df: DataFrame, label: str, test_fraction: float, seed: int = 42,
                     id_col: str = "order_id") -> DataFrame:
    """Random hold-out with floor(fraction * n) rows of every class, fixed by the id hash."""
    ranked = global_rank(df.withColumn("_h", hash_order(id_col, seed)), [F.col("_h"), F.col(id_col)], [label])
    return ranked.withColumn("split", F.when(F.col("rank") <= F.floor(F.lit(test_fraction) * F.col("n")), "test")
                             .otherwise("train")).drop("_h", "rank", "n")
