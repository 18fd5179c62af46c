"""As-of joins and running histories that split a hot entity over the calendar.

Both work in two levels: inside (entity, day) blocks, and over one row per
(entity, day). No window ever holds more than one day of an entity's rows or one
row per day of its lifetime.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_history(events: DataFrame, by: Sequence[str], time: str, sums: Mapping[str, Column]) -> DataFrame:
    """Cumulative sums per entity at each distinct event time (inclusive of that time)."""
    by = list(by)
    at_time = (events.groupBy(*by, time).agg(*[F.sum(e).alias(k) for k, e in sums.items()])
               .withColumn("_day", F.to_date(time)))
    per_day = at_time.groupBy(*by, "_day").agg(*[F.sum(k).alias(f"_d_{k}") for k in sums])
    earlier = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_day.select(*by, "_day", *[F.coalesce(F.sum(f"_d_{k}").over(earlier), F.lit(0)).alias(f"_off_{k}")
                                          for k in sums])
    today = Window.partitionBy(*by, "_day").orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = at_time.select(*by, time, "_day", *[F.sum(k).over(today).alias(k) for k in sums])
    return (inside.join(carry, [*by, "_day"])
            .select(*by, time, *[(F.col(k) + F.col(f"_off_{k}")).alias(k) for k in sums]))


def asof_state(requests: DataFrame, states: DataFrame, by: Sequence[str], request_time: str, state_time: str,
               payload: Sequence[str], strict: bool) -> DataFrame:
    """Newest state before each request (``strict``) or at-or-before it, joined to the requests.

    ``states`` holds at most one row per (entity, time). Lookups run on the distinct
    (entity, time) pairs of the requests, so the ordered work does not grow with the
    number of requests that share a pair. Without ``by`` the state is global and the
    lookup runs on distinct times alone.
    """
    by = list(by)
    asked, stated = (0, 1) if strict else (1, 0)
    state = F.struct(*payload)
    points = requests.select(*by, F.col(request_time).alias("_t")).where("_t IS NOT NULL").distinct()
    both = (points.select(*by, "_t", F.lit(asked).alias("_side"), F.lit(None).cast(
                states.select(state.alias("s")).schema["s"].dataType).alias("_state"))
            .unionByName(states.where(F.col(state_time).isNotNull()).select(
                *by, F.col(state_time).alias("_t"), F.lit(stated).alias("_side"), state.alias("_state")))
            .withColumn("_day", F.to_date("_t")))
    today = Window.partitionBy(*by, "_day").orderBy("_t", "_side") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_now", F.last("_state", ignorenulls=True).over(today)).where(F.col("_side") == asked)
    per_day = both.groupBy(*by, "_day").agg(
        F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col("_t"))).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_day.select(*by, "_day", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    answers = (found.join(carry, [*by, "_day"])
               .select(*by, F.col("_t").alias(request_time), F.coalesce("_now", "_before").alias("_s"))
               .select(*by, request_time, *[F.col(f"_s.{p}").alias(p) for p in payload]))
    return requests.join(answers, [*by, request_time], "left")
