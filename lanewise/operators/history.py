"""Leakage-safe seller and product histories."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import holds, ratio
from ..functions.times import calendar_days, day
from .asof import asof_state, running_history


def _delivered_pairs(orders: DataFrame, items: DataFrame) -> DataFrame:
    pairs = items.select("order_id", "seller_id").distinct()
    done = orders.where("order_status = 'delivered' AND delivered_at IS NOT NULL AND estimated_at IS NOT NULL") \
        .withColumn("deviation_days", calendar_days("delivered_at", "estimated_at")) \
        .withColumn("late", (F.col("deviation_days") > 0).cast("int"))
    return pairs.join(done.select("order_id", "purchase_ts", "approved_at", "delivered_at", "deviation_days", "late"),
                      "order_id")


def seller_running_history(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Completed orders, late orders and deviation per seller up to each delivery time."""
    run = running_history(_delivered_pairs(orders, items), ["seller_id"], "delivered_at", {
        "prior_completed_orders": F.lit(1).cast("bigint"), "prior_late_orders": F.col("late").cast("bigint"),
        "prior_deviation_sum": F.col("deviation_days").cast("bigint")})
    return (run.withColumn("prior_late_rate", ratio("prior_late_orders", "prior_completed_orders"))
            .withColumn("prior_mean_deviation", ratio("prior_deviation_sum", "prior_completed_orders")))


def seller_history(orders: DataFrame, items: DataFrame, at: str = "approved_at") -> DataFrame:
    """State of every delivered order's sellers strictly before ``at``."""
    requests = _delivered_pairs(orders, items).where(F.col(at).isNotNull())
    states = seller_running_history(orders, items)
    out = asof_state(requests, states, ["seller_id"], at, "delivered_at",
                     ["prior_completed_orders", "prior_late_rate", "prior_mean_deviation"], strict=True)
    return out.withColumn("prior_completed_orders", F.coalesce("prior_completed_orders", F.lit(0)))


def order_history_rollup(history: DataFrame) -> DataFrame:
    return history.groupBy("order_id").agg(
        F.min("prior_completed_orders").alias("minimum_seller_history"),
        F.max("prior_late_rate").alias("maximum_prior_late_rate"),
        F.max("prior_mean_deviation").alias("maximum_prior_mean_deviation"),
        F.count_if(F.col("prior_completed_orders") == 0).alias("new_seller_count"))


def known_outcomes(orders: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Verdict of each order and the first day on which it may be used."""
    approved, delivered, promised = day("approved_at"), day("delivered_at"), day("estimated_at")
    ok = approved.isNotNull() & promised.isNotNull() & ~holds(delivered < approved)
    on_time = holds(delivered <= promised)
    verdict_day = F.date_add(F.when(on_time, delivered).otherwise(promised), 1)
    known = orders.where(ok).select("order_id", (~on_time).cast("bigint").alias("late"),
                                    F.greatest(verdict_day, F.date_add(approved, 1)).alias("known_day"))
    return known if excluded is None else known.join(excluded.select("order_id"), "order_id", "left_anti")


def smoothed_entity_history(orders: DataFrame, items: DataFrame, entity: str, prefix: str, smoothing: float = 10.0,
                            excluded: DataFrame | None = None) -> DataFrame:
    """Mean smoothed late rate and share of unseen entities per order, as known on approval day.

    The prior is the global late rate as of the same day (0.5 before any verdict).
    """
    known = known_outcomes(orders, excluded)
    counts = {"prior_n": F.lit(1).cast("bigint"), "prior_late_n": F.col("late")}
    asked = orders.where("approved_at IS NOT NULL").select("order_id", day("approved_at").alias("approved_day"))
    overall = asof_state(asked, running_history(known, [], "known_day", counts), [], "approved_day", "known_day",
                         ["prior_n", "prior_late_n"], strict=False) \
        .select("order_id", "approved_day", F.coalesce(ratio("prior_late_n", "prior_n"), F.lit(0.5)).alias("global_rate"))
    member = items.select("order_id", entity).where(F.col(entity).isNotNull()).distinct()
    states = running_history(member.join(known, "order_id"), [entity], "known_day", counts)
    seen = asof_state(member.join(overall, "order_id"), states, [entity], "approved_day", "known_day",
                      ["prior_n", "prior_late_n"], strict=False)
    n, late = (F.coalesce(c, F.lit(0)) for c in ("prior_n", "prior_late_n"))
    rate = F.coalesce(ratio(late + F.lit(smoothing) * F.col("global_rate"), n + F.lit(smoothing)), F.col("global_rate"))
    per_order = seen.select("order_id", rate.alias("r"), (n == 0).cast("double").alias("u")).groupBy("order_id").agg(
        F.avg("r").alias("_rate"), F.avg("u").alias("_unseen"))
    return overall.join(per_order, "order_id", "left").select(
        "order_id", F.coalesce("_rate", "global_rate").alias(f"{prefix}_late_rate_mean"),
        F.coalesce("_unseen", F.lit(1.0)).alias(f"{prefix}_no_history_share"))
