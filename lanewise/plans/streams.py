"""Streaming forms of the daily counts, label maturity and monitor."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams
from .catalog import Base, query
from .oracle import CUTOFF, label, status


class Streamed(Base):
    """Role views over file streams instead of batch reads."""

    def raw(self, name):
        return streams.read_stream(self.spark, self.path, name)


@query("stream_daily_counts", "SELECT approved_at::DATE AS day, count(*) AS orders FROM r_orders WHERE approved_at IS NOT NULL GROUP BY 1")
def _(t):
    orders = Streamed(t.spark, t.path).orders.where("approved_at IS NOT NULL")
    return streams.daily_counts(orders, "approved_at")


@query("stream_monitor", """SELECT (d - o)::DATE AS first_day, count(*) AS records, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE score > 1 OR score < 0) AS out_of_range
    FROM (SELECT *, ts::DATE AS d FROM r_log), range(0, 7) r(o) GROUP BY 1""".replace("(d - o)", "(d - o::INTEGER)"))
def _(t):
    log = Streamed(t.spark, t.path).prediction_log
    return streams.sliding_monitor(log, "ts", "score", 0.0, 1.0)


MATURE = f"""WITH mx AS (SELECT greatest(max(approved_at), max(delivered_at) FILTER (WHERE approved_at IS NOT NULL)) - INTERVAL 1 DAY AS w FROM r_orders)
    SELECT order_id, {label(CUTOFF)}::BIGINT AS label, {status(CUTOFF)} AS label_status, CASE WHEN delivered_at::DATE <= approved_at::DATE + 45
    THEN greatest(delivered_at::DATE, approved_at::DATE) ELSE approved_at::DATE + 45 END AS decided_on FROM r_orders, mx
    WHERE approved_at IS NOT NULL AND (delivered_at::DATE <= approved_at::DATE + 45 OR (approved_at::DATE + 46)::TIMESTAMP < w)"""


@query("stream_label_maturity", MATURE)
def _(t):
    """Labels from approval and delivery events; orders decided so far."""
    orders = Streamed(t.spark, t.path).orders.where("approved_at IS NOT NULL")
    marks = F.array_compact(F.array(F.struct(F.lit("approved").alias("kind"), F.col("approved_at").alias("event_ts")),
                                    F.when(F.col("delivered_at").isNotNull(), F.struct(F.lit("delivered").alias("kind"), F.col("delivered_at").alias("event_ts")))))
    events = orders.select("order_id", F.col("estimated_at").cast("date").alias("deadline"), F.explode(marks).alias("e")).select(
        "order_id", F.col("e.event_ts").cast("timestamp").alias("event_ts"), "e.kind", "deadline")
    return streams.label_maturity(events)
