"""Nested per-day snapshots: parquet sinks with labels kept apart, and JSON readers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import day


def daily_snapshots(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per order with its approval-time features nested.

    ``delivered_at`` is carried for the exclusion of orders already delivered on the run day; labels are not.
    """
    return features.select(day("approved_at").alias("approval_day"), "order_id", "approved_at",
                           F.col("estimated_at").alias("promised_at"), "delivered_at",
                           F.struct(*columns).alias("features"))


def write_daily_snapshots(snapshots: DataFrame, outcomes: DataFrame, folder: str) -> None:
    """Two sinks, so a reader of the worklist inputs never touches an outcome.

    Folders are months and rows are sorted by day inside their files: one day reads
    one folder and skips row groups, while quiet days do not become tiny files.
    """
    for df, name in ((snapshots, "snapshots"), (outcomes, "outcomes")):
        monthly = df.withColumn("approval_month", F.date_format("approval_day", "yyyy-MM"))
        (monthly.hint("rebalance", "approval_month").sortWithinPartitions("approval_month", "approval_day")
         .write.mode("overwrite").option("compression", "zstd").partitionBy("approval_month")
         .parquet(f"{folder}/{name}"))


def read_day_json(spark: SparkSession, path: str, row_schema: str, lines: bool = False) -> DataFrame:
    """``{"days": {date: [row, ...]}}`` documents, one row per order.

    ``lines``: one document per line, which splits over tasks; else one document per file.
    """
    raw = spark.read.schema(f"days map<string, array<{row_schema}>>").option("multiLine", not lines).json(path)
    by_day = raw.select(F.explode("days").alias("approval_day", "rows"))
    return by_day.select(F.to_date("approval_day").alias("approval_day"), F.explode("rows").alias("row")) \
        .select("approval_day", "row.*")


def write_keyed_json(df: DataFrame, path: str, field: str, key: str, value: Column, rows: int = 10_000) -> None:
    """``{field: {key: value | null}}`` documents, one per line, of about ``rows`` keys each; keys are unique."""
    parts = max(1, -(-df.count() // rows))
    df.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("_part")).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col(key).cast("string"), value.alias("value")))).alias(field)).select(field).write.json(path)


def read_keyed_json(spark: SparkSession, path: str, field: str, value_type: str, lines: bool = False) -> DataFrame:
    """(order_id, value) of ``{field: {order_id: value | null}}`` documents: outcomes, or actual days from the promise."""
    raw = spark.read.schema(f"{field} map<string, {value_type}>").option("multiLine", not lines).json(path)
    return raw.select(F.explode(field).alias("order_id", "value"))


def read_score_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``{"scores": {order_id: [p, days] | null}}`` files."""
    return read_keyed_json(spark, path, "scores", "array<double>", lines).select(
        "order_id", F.get("value", F.lit(0)).alias("p"), F.get("value", F.lit(1)).alias("days"))
