"""Structured Streaming forms of the daily batch work.

Files arrive in any order, so no result here may depend on a watermark: every micro-batch is reduced to mergeable partial values
(counts, sums, first and last dates) and written under its epoch, and the reader merges the epochs. Nothing is dropped as late, no
state is held between batches, and a replayed batch overwrites its own epoch. With the same `out` and `progress` folders a later
run goes on where the earlier one stopped.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

PROGRESS_LAG_DAYS = 1  # a day counts as over when an event of the next but one has been seen


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """File stream over one table, a file or a folder of part files; the schema is the table's own."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    first = table.select("_metadata.file_name").first()
    if first and first[0] == f"{name}.parquet":  # a file stream reads folders: pick the one file out of its folder
        return reader.option("pathGlobFilter", first[0]).parquet(folder)
    return reader.parquet(path)


def collect_partials(stream: DataFrame, name: str, reduce: Callable[[DataFrame], DataFrame], out: str | None = None,
                     progress: str | None = None) -> DataFrame:
    """Runs the stream to the end of its present files and returns the partial rows of all epochs so far.

    Give `out` and `progress`, in a folder all executors share, to continue an earlier run; fresh ones are made otherwise.
    """
    spark = stream.sparkSession
    out, progress = out or shared_path(spark, f"{name}-out"), progress or shared_path(spark, f"{name}-progress")

    def save(batch: DataFrame, epoch: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("epoch")


def daily_counts(stream: DataFrame, ts: str, name: str = "daily-counts", **folders) -> DataFrame:
    """Events per calendar day, the input of the trailing load."""
    parts = collect_partials(stream, name, lambda b: b.groupBy(F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("orders")), **folders)
    return parts.groupBy("day").agg(F.sum("orders").alias("orders"))


def sliding_monitor(stream: DataFrame, ts: str, score: str, low: float, high: float, days: int = 7, name: str = "monitor", **folders) -> DataFrame:
    """Mean score and out-of-range records per window of `days` days that starts on each day."""
    odd = (F.col(score) < low) | (F.col(score) > high)
    parts = collect_partials(stream, name, lambda b: b.groupBy(F.col(ts).cast("date").alias("d")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(score).alias("total"), F.count(score).alias("scored"), F.count_if(odd).alias("out_of_range")), **folders)
    starts = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_sub("d", k))
    return parts.withColumn("first_day", F.explode(starts)).groupBy("first_day").agg(
        F.sum("records").alias("records"), (F.sum("total") / F.sum("scored")).alias("mean_score"), F.sum("out_of_range").alias("out_of_range"))


def label_maturity(events: DataFrame, lookback: int = 45, name: str = "label-maturity", **folders) -> DataFrame:
    """Each order's label once it is decided: at delivery, or when the day after its cutoff is over.

    `events` has (order_id, event_ts, kind, deadline) with kind 'approved' or 'delivered'. A batch leaves one row of dates per order
    it touches; orders without an approval so far stay out.
    """
    def when(kind: str):
        return F.min(F.when(F.col("kind") == kind, F.col("event_ts").cast("date"))).alias(kind)
    parts = collect_partials(events, name, lambda b: b.groupBy("order_id").agg(
        when("approved"), when("delivered"), F.max(F.when(F.col("kind") == "approved", F.col("deadline"))).alias("deadline"), F.max("event_ts").alias("seen")), **folders)
    seen = parts.agg(F.max("seen")).first()[0]
    orders = parts.groupBy("order_id").agg(F.min("approved").alias("approved"), F.min("delivered").alias("delivered"), F.max("deadline").alias("deadline")) \
        .where("approved IS NOT NULL").withColumn("cutoff", F.date_add("approved", lookback))
    in_time = F.coalesce(F.col("delivered") <= F.col("cutoff"), F.lit(False))
    over = F.date_add("cutoff", 1).cast("timestamp") < F.lit(seen) - F.expr(f"INTERVAL {PROGRESS_LAG_DAYS} DAY")
    broken = F.col("deadline").isNull() | F.coalesce(F.col("delivered") < F.col("approved"), F.lit(False))
    late = F.when(in_time, F.col("delivered") > F.col("deadline")).when(F.col("deadline") <= F.col("cutoff"), F.lit(True))
    status = F.when(broken, "invalid_or_missing_dates").when(in_time & late, "late_delivered").when(in_time, "on_time_delivered") \
        .when(late, "late_undelivered").otherwise("unresolved")
    return orders.where(in_time | over).select("order_id", F.when(~broken, late.cast("int")).alias("label"), status.alias("label_status"),
                                               F.when(in_time, F.greatest("delivered", "approved")).otherwise(F.col("cutoff")).alias("decided_on"))
