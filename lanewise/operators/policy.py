"""Daily follow-up worklist over all days at once, with retrospective replay."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite, n_rows, ratio
from ..functions.times import day
from .ordering import global_rank


def candidates(orders: DataFrame) -> DataFrame:
    """Orders of each batch day still open at the next midnight and with a promise date."""
    out = orders.where("approved_at IS NOT NULL AND estimated_at IS NOT NULL").withColumn("run_day", F.date_add(day("approved_at"), 1))
    return out.where(F.col("delivered_at").isNull() | (F.col("delivered_at") >= F.col("run_day").cast("timestamp_ntz")))


def worklist(orders: DataFrame, scores: DataFrame, min_days: int, score: str = "p") -> DataFrame:
    """Every batch order with its exclusion reasons or its rank for the morning after approval.

    ``scores`` without a value marks invalid inputs. Reasons may overlap; the rank
    orders eligible rows by (score desc, id) within a run day of any size.
    """
    if isinstance(min_days, bool) or not isinstance(min_days, int) or not 0 <= min_days <= 365:
        raise ValueError("min_days must be an integer between 0 and 365")
    run_day = F.date_add(day("approved_at"), 1)
    # Reasons are settled before the join: only the ranking key travels on.
    promise = day("estimated_at")
    known = F.array_compact(F.array(
        F.when(F.col("delivered_at") < run_day.cast("timestamp_ntz"), F.lit("already_delivered")),
        F.when(promise.isNull(), F.lit("missing_promised_delivery_date")),
        F.when(F.datediff(promise, run_day) <= min_days, F.lit("insufficient_time_remaining"))))
    base = orders.where("approved_at IS NOT NULL").select("order_id", run_day.alias("run_day"), promise.alias("promised_day"), known.alias("_r")) \
        .join(scores.select("order_id", finite(score).alias(score)), "order_id", "left")
    reasons = F.when((F.size("_r") == 0) & F.col(score).isNull(), F.array(F.lit("invalid_model_inputs"))).otherwise(F.col("_r"))
    rows = base.withColumn("reasons", reasons).drop("_r")
    ranked = global_rank(rows.where(F.size("reasons") == 0), [F.desc(score), F.asc("order_id")], ["run_day"]) \
        .withColumnRenamed("n", "eligible")
    rest = rows.where(F.size("reasons") > 0).withColumn("rank", F.lit(None).cast("bigint")).withColumn("eligible", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)


def selected(share: float) -> Column:
    if isinstance(share, bool) or not 0 <= share <= 1:
        raise ValueError("share must be between 0 and 1")
    return F.coalesce(F.col("rank") <= F.ceil(F.lit(float(share)) * F.col("eligible")), F.lit(False))


def exclusion_counts(wl: DataFrame) -> DataFrame:
    return wl.select("run_day", F.explode("reasons").alias("reason")).groupBy("run_day", "reason").agg(n_rows("orders"))


def attach_outcomes(wl: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes join after ranking; ``outcome`` is 0, 1, 'canceled' or missing, as (label, canceled)."""
    return wl.join(outcomes.select("order_id", "label", "canceled"), "order_id", "left")


def month_summary(replay: DataFrame, share: float) -> DataFrame:
    """Per day and pooled counts and coverage for one follow-up share."""
    pick, open_ = selected(share), F.col("rank").isNotNull()
    late, known = F.col("label") == 1, F.col("label").isNotNull()
    out = replay.withColumn("_s", pick).rollup("run_day").agg(
        F.grouping("run_day").alias("_g"), n_rows("total"), F.count_if(open_).alias("eligible"), F.count_if("_s").alias("selected"),
        F.count_if(F.col("_s") & known).alias("selected_known"), F.count_if(known).alias("known_all"),
        F.count_if(F.col("_s") & late).alias("late_caught"), F.count_if(open_ & late).alias("late_eligible"), F.count_if(late).alias("late_all"))
    return out.where("_g = 1 OR run_day IS NOT NULL").withColumn("level", F.when(F.col("_g") == 1, "pooled").otherwise("day")).drop("_g") \
        .withColumn("selected_late_rate", ratio("late_caught", "selected_known")) \
        .withColumn("eligible_late_coverage", ratio("late_caught", "late_eligible")) \
        .withColumn("all_late_coverage", ratio("late_caught", "late_all"))


def monthly_ranking(orders: DataFrame, scores: DataFrame, outcomes: DataFrame, share: float, score: str = "p") -> DataFrame:
    """One ranking per approval month (hindsight of the whole cohort), for comparison."""
    rows = orders.where("approved_at IS NOT NULL").select("order_id", F.date_format(day("approved_at"), "yyyy-MM").alias("month")) \
        .join(scores.where(F.col(score).isNotNull()), "order_id").join(outcomes.select("order_id", "label"), "order_id", "left")
    ranked = global_rank(rows, [F.desc(score), F.asc("order_id")], ["month"])
    pick, late = F.col("rank") <= F.ceil(F.lit(float(share)) * F.col("n")), F.col("label") == 1
    return ranked.groupBy("month").agg(n_rows("total"), F.count_if(pick).alias("selected"), F.count_if(pick & late).alias("late_caught"),
                                       F.count_if(late).alias("late_all")).withColumn("all_late_coverage", ratio("late_caught", "late_all"))


def buffer_scores(scores: DataFrame) -> DataFrame:
    """Rank by the timing model instead: later against the promise is riskier."""
    return scores.select("order_id", F.col("days").alias("p"))


def effort_curve(ranked: DataFrame, rank: str, size: str, late_total: int, shares: Sequence[float], method: str) -> DataFrame:
    """Late rows caught at each share.

    Each row is assigned the first share that selects it, so the curve is a running
    sum over one row per share instead of a copy of the rows per share.
    """
    grid = F.array(*[F.lit(float(s)) for s in shares])
    first = F.element_at(F.filter(grid, lambda s: F.ceil(s * F.col(size)) >= F.col(rank)), 1)
    at = ranked.where(F.col(rank).isNotNull()).groupBy(first.alias("share")).agg(n_rows("n"), F.count_if(F.col("label") == 1).alias("late"))
    steps = ranked.sparkSession.createDataFrame([(float(s),) for s in shares], "share double").join(at, "share", "left")
    w = Window.orderBy("share").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    caught = F.coalesce(F.sum("late").over(w), F.lit(0))
    return steps.select(F.lit(method).alias("method"), "share", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("selected"), caught.alias("late_caught"),
                        ratio(caught, F.lit(late_total)).alias("coverage"))


def timing_accuracy(df: DataFrame) -> DataFrame:
    """Timing error overall and per approval day."""
    e = F.col("days") - F.col("target")
    out = df.where("days IS NOT NULL AND target IS NOT NULL").rollup("approval_day").agg(
        F.grouping("approval_day").alias("_g"), n_rows("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.avg("target").alias("mean_actual"), F.avg("days").alias("mean_predicted"), F.avg(F.when(F.col("label") == 1, F.col("days"))).alias("predicted_late"),
        F.avg(F.when(F.col("label") == 0, F.col("days"))).alias("predicted_on_time"))
    return out.withColumn("level", F.when(F.col("_g") == 1, "all").otherwise("day")).drop("_g")


def retrospective_counts(replay: DataFrame, share: float) -> DataFrame:
    """Outcome counts of all, eligible and selected rows per run day and overall."""
    groups = F.array_compact(F.array(F.lit("all"), F.when(F.col("rank").isNotNull(), F.lit("eligible")), F.when(selected(share), F.lit("selected"))))
    known, gone = F.col("label").isNotNull(), F.coalesce(F.col("canceled"), F.lit(False))
    return replay.withColumn("population", F.explode(groups)).groupBy("population").agg(
        n_rows("total"), F.count_if(known).alias("known"), F.count_if(~known & ~gone).alias("unknown"), F.count_if(gone).alias("canceled"),
        F.count_if(F.col("label") == 1).alias("late")).withColumn("late_rate", ratio("late", "known"))


def cumulative_caught(daily: DataFrame) -> DataFrame:
    """Running totals of late and caught orders over the run days (one row per day)."""
    w = Window.orderBy("run_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.where("level = 'day'").select("run_day", F.sum("late_all").over(w).alias("late_so_far"), F.sum("late_caught").over(w).alias("caught_so_far"))


def prediction_monitor(log: DataFrame, recent: int = 1000, warnings: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Totals, the newest records and the newest out-of-range records of a prediction log."""
    newest = [F.desc("ts"), F.desc("event_id")]
    def part(df, name):
        return df.agg(n_rows("records"), F.avg("score").alias("mean_score"), F.max("ts").cast("date").alias("last_day")).select(F.lit(name).alias("view"), "*")
    odd = log.where((F.col("score") < low) | (F.col("score") > high))
    return part(log, "all").unionByName(part(log.orderBy(*newest).limit(recent), "recent")) \
        .unionByName(part(odd, "warnings")).unionByName(part(odd.orderBy(*newest).limit(warnings), "recent warnings"))


def risk_vs_actual(df: DataFrame, by: str, min_orders: int = 1) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        n_rows("orders"), F.avg("label").alias("late_rate"), F.avg("p").alias("mean_risk"), F.avg("target").alias("mean_actual_days"),
        F.avg("days").alias("mean_predicted_days")).where(F.col("orders") >= min_orders)
