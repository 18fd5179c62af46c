"""Set operations, reshaping, calendar spines and reproducible samples."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import global_rank, hash_order


def concat_columns(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Side-by-side tables on a key; columns get the part's name as suffix."""
    named = [df.select(key, *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != key]) for name, df in parts.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), named)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def pivot_wide(df: DataFrame, index: Sequence[str], column: str, values: Sequence, agg: Column) -> DataFrame:
    """Long to wide with a stated value list: no extra job to discover the columns."""
    return df.groupBy(*index).pivot(column, list(values)).agg(agg)


def calendar_spine(daily: DataFrame, day: str, values: Sequence[str]) -> DataFrame:
    """Dense calendar between the first and last day, absent days as 0."""
    span = daily.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b")).alias(day))
    return spine.join(daily, day, "left").select(day, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def sample_one_per_day(df: DataFrame, day: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """One hash-chosen row per day, topped up to ``n`` rows, in day order."""
    rest = [c for c in df.columns if c != day]
    key = F.struct(hash_order(id_col, seed), F.col(id_col))
    daily = df.groupBy(day).agg(F.min_by(F.struct(*rest), key).alias("_r")).select(day, "_r.*").select(*df.columns)
    more = df.join(daily.select(id_col), id_col, "left_anti").select(*df.columns)
    pool = daily.withColumn("_o", F.lit(0)).unionByName(more.withColumn("_o", F.lit(1)))
    return pool.orderBy("_o", hash_order(id_col, seed), id_col).limit(n).drop("_o")


def subsample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by hash order, kept distributed."""
    return global_rank(df.withColumn("_h", hash_order(id_col, seed)), [F.col("_h"), F.col(id_col)]) \
        .where(F.col("rank") <= n).drop("_h", "rank", "n")
