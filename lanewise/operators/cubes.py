"""Descriptive cubes: rates, shares, bands, rollups and rankings.

All are partial-aggregating group-bys. Quantiles of whole-day columns use the
built-in exact percentile (few distinct values per group); continuous measures go
through ``ordering.exact_quantiles``.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import (DISTANCE_EDGES, DISTANCE_LABELS, EXPERIENCE_EDGES, EXPERIENCE_LABELS, REVIEW_EDGES,
                               REVIEW_LABELS, TRACK_EDGES, TRACK_LABELS, WINDOW_EDGES, WINDOW_LABELS,
                               cut_left_closed, cut_right_closed, equal_width_bin)
from ..functions.nulls import n_rows, percent, ratio
from ..functions.scalars import keep_top, recode, route_label
from ..functions.times import col, day, month_label
from .ordering import exact_quantiles, qcut_code, quantile_edges, quantile_values

# Display names of label statuses and weekdays.
STATUS_NAMES = {"on_time_delivered": "Delivered on time", "late_delivered": "Delivered late",
                "late_undelivered": "Late, not delivered", "unresolved": "Unresolved",
                "canceled_or_unavailable": "Canceled or unavailable", "invalid_or_missing_dates": "Invalid dates"}
WEEKDAYS = {1: "Mon", 2: "Tue", 3: "Wed", 4: "Thu", 5: "Fri", 6: "Sat", 7: "Sun"}


def delivered_basis(df: DataFrame) -> DataFrame:
    """Late outcome of delivered orders only."""
    return df.withColumn("late", F.when(F.col("order_status") == "delivered", F.col("late")))


def late_rate_by(df: DataFrame, *keys: str, min_orders: int = 1) -> DataFrame:
    known = df.where(F.col("late").isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(n_rows("orders"), F.avg("late").alias("late_rate")).where(F.col("orders") >= min_orders)


def dashboard_filter(df: DataFrame, dates: tuple | None = None, date_col: str = "approved_day",
                     members: Mapping[str, Sequence] | None = None, ranges: Mapping[str, tuple] | None = None,
                     include_missing: Sequence[str] = ()) -> DataFrame:
    """Conjunction of optional predicates; a range may let missing values through."""
    if dates:
        df = df.where(F.col(date_col).between(*[F.lit(d).cast("date") for d in dates]))
    for c, values in (members or {}).items():
        if values:
            df = df.where(F.col(c).isin(list(values)))
    for c, (lo, hi) in (ranges or {}).items():
        cond = F.col(c).between(lo, hi)
        df = df.where(cond | F.col(c).isNull() if c in include_missing else cond)
    return df


def monthly_late_rate(df: DataFrame) -> DataFrame:
    return df.where("late IS NOT NULL").groupBy("approved_month").agg(
        n_rows("delivered"), F.avg("late").alias("late_rate"))


def monthly_rate_average(monthly: DataFrame) -> DataFrame:
    return monthly.agg(F.avg("late_rate").alias("mean_monthly_rate"), F.median("late_rate").alias("median_monthly_rate"),
                       n_rows("months"))


def top_categories(items: DataFrame, n: int) -> list:
    """Names of the n largest categories (count, then name)."""
    rows = items.where("category IS NOT NULL").groupBy("category").agg(n_rows("c")) \
        .orderBy(F.desc("c"), "category").limit(n).collect()
    return [r[0] for r in rows]


def top_category_trend(items: DataFrame, top: Sequence[str]) -> DataFrame:
    return items.where(F.col("category").isin(list(top))).groupBy("month", "category").agg(n_rows("items"))


def route_share_by_state(df: DataFrame, top: Sequence[str], routes: Sequence[str]) -> DataFrame:
    """Route share within top states and 'Others', as one column per route."""
    counts = (df.where("route_type IS NOT NULL").withColumn("state", keep_top("customer_state", top))
              .groupBy("state", "route_type").agg(n_rows("n")))
    shared = counts.withColumn("pct", percent("n", F.sum("n").over(Window.partitionBy("state"))))
    return shared.groupBy("state").pivot("route_type", list(routes)).agg(F.max("pct"))


def share_within_group(df: DataFrame, group: str, item: str) -> DataFrame:
    counts = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(n_rows("n"))
    return counts.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy(group))))


def review_score_distribution(df: DataFrame) -> DataFrame:
    return df.where("review_score IS NOT NULL").groupBy(F.bround("review_score").cast("int").alias("score")) \
        .agg(n_rows("orders"))


def monthly_sales(df: DataFrame) -> DataFrame:
    """Orders, revenue and average order value: per order, and per order with a payment.

    Amounts are added as whole cents, so the total does not depend on task order.
    """
    cents = F.sum(F.round(F.col("payment_value") * 100).cast("bigint")) / F.lit(100.0)
    return df.groupBy("approved_month").agg(n_rows("orders"), cents.alias("revenue"), F.count("payment_value").alias("_paid")) \
        .withColumn("mean_paid_order", ratio("revenue", "_paid")).withColumn("average_order", ratio("revenue", "orders")).drop("_paid")


def status_share(df: DataFrame, c: str = "order_status") -> DataFrame:
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(n_rows("orders"))
    return counts.withColumn("share", ratio("orders", F.sum("orders").over(Window.partitionBy())))


def category_summary(star: DataFrame) -> DataFrame:
    """Orders, units, value and revenue per unit by category.

    Two levels, so the distinct orders of a hot category are counted in parallel.
    """
    per = star.where("category IS NOT NULL").groupBy("category", "order_id").agg(n_rows("q"), F.sum("price").alias("v"))
    return per.groupBy("category").agg(n_rows("orders"), F.sum("q").alias("quantity"), F.sum("v").alias("value")) \
        .withColumn("value_per_unit", ratio("value", "quantity"))


def state_distribution(parties: DataFrame, prefix: str) -> DataFrame:
    """Parties, cities and per-city density by state."""
    cities = parties.groupBy(f"{prefix}_state", f"{prefix}_city").agg(F.count_distinct(f"{prefix}_id").alias("n"))
    per = cities.groupBy(F.col(f"{prefix}_state").alias("state")).agg(
        F.sum("n").alias("members"), F.count(f"{prefix}_city").alias("cities"))
    return per.withColumn("share_pct", percent("members", F.sum("members").over(Window.partitionBy()))) \
        .withColumn("members_per_city", ratio("members", "cities"))


def item_share_by_state(star: DataFrame) -> DataFrame:
    """Item share by customer state against seller state."""
    from .joins import outer_compare

    def side(c, name):
        counts = star.groupBy(F.col(c).alias(name)).agg(n_rows("n"))
        return counts.withColumn(f"{name}_share", percent("n", F.sum("n").over(Window.partitionBy()))).drop("n")
    both = outer_compare(side("customer_state", "buyer"), side("seller_state", "seller"), "buyer", "seller", "state")
    return both.withColumn("seller_to_buyer", ratio("seller_share", "buyer_share"))


def weekday_hour(df: DataFrame) -> DataFrame:
    return df.groupBy("purchase_weekday", "purchase_hour").agg(n_rows("orders")) \
        .withColumn("weekday", recode("purchase_weekday", WEEKDAYS))


def most_common(df: DataFrame, column: str, n: int) -> list:
    """The ``n`` values with most rows, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    return [r[0] for r in counts.orderBy(F.desc("count"), column).limit(n).collect()]


def weekday_hour_grid(df: DataFrame, hours: Sequence[int]) -> DataFrame:
    """Distinct orders per weekday and hour."""
    return df.groupBy("purchase_weekday").pivot("purchase_hour", list(hours)).agg(F.count_distinct("order_id")).na.fill(0)


def route_late_summary(df: DataFrame) -> DataFrame:
    """Volume, late rate and median days late of the late orders, by route."""
    return df.where("route_type IS NOT NULL AND late IS NOT NULL").groupBy("route_type").agg(
        n_rows("delivered"), F.avg("late").alias("late_rate"),
        F.median(F.when(F.col("late") == 1, F.col("days_from_promise"))).alias("median_days_late"))


def total_row_rollup(df: DataFrame, key: str, total: str = "Total") -> DataFrame:
    """Groups plus a Total row from one aggregation."""
    return df.where(F.col(key).isNotNull() & F.col("late").isNotNull()).rollup(key).agg(
        F.grouping(key).alias("_g"), n_rows("orders"), F.sum(F.col("late").cast("bigint")).alias("late_orders"),
        F.avg("late").alias("late_rate")).select(
        F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key)).alias("group"), "orders", "late_orders", "late_rate")


def route_pair_late(df: DataFrame, min_orders: int, top: int) -> DataFrame:
    """Busiest seller-state to customer-state routes with their late rate."""
    routes = df.where("primary_seller_state IS NOT NULL AND customer_state IS NOT NULL") \
        .withColumn("route", route_label("primary_seller_state", "customer_state"))
    return late_rate_by(routes, "route", min_orders=min_orders).orderBy(F.desc("orders"), "route").limit(top)


def stage_share(df: DataFrame, how: str = "mean") -> DataFrame:
    """Share of total time per stage by outcome (mean), or median days per stage."""
    base = df.where("late IS NOT NULL AND approval_to_carrier_days IS NOT NULL AND approval_to_customer_days IS NOT NULL") \
        .withColumn("outcome", F.when(F.col("late") == 1, "Late").otherwise("On time")) \
        .withColumn("to_carrier", F.col("approval_to_carrier_days")) \
        .withColumn("to_customer", F.col("approval_to_customer_days") - F.col("approval_to_carrier_days"))
    stages = ["to_carrier", "to_customer"]
    if how == "median":
        return exact_quantiles(base, ["outcome"], stages, {"days": 0.5}) \
            .select("outcome", F.col("variable").alias("stage"), "days")
    total = F.col("to_carrier") + F.col("to_customer")
    ok = base.where((F.col("to_carrier") >= 0) & (F.col("to_customer") >= 0) & (total > 0))
    wide = ok.groupBy("outcome").agg(*[F.avg(F.col(s) / total).alias(s) for s in stages])
    return wide.unpivot("outcome", stages, "stage", "share")


def band_summary(df: DataFrame, band: Column) -> DataFrame:
    """Orders, late rate, median deviation and median days late by band."""
    late_days = F.when(F.col("late") == 1, F.col("days_from_promise"))
    out = df.withColumn("band", band).where("band IS NOT NULL AND late IS NOT NULL").groupBy("band").agg(
        n_rows("orders"), F.avg("late").alias("late_rate"), F.median("days_from_promise").alias("median_deviation"),
        F.median(late_days).alias("median_days_late"))
    return out.withColumn("share_pct", percent("orders", F.sum("orders").over(Window.partitionBy())))


def distance_band() -> Column:
    return cut_left_closed("seller_dist_km_mean", DISTANCE_EDGES, DISTANCE_LABELS)


def window_band() -> Column:
    return cut_left_closed("promised_lead_days", WINDOW_EDGES, WINDOW_LABELS)


def quintile_summary(df: DataFrame, attribute: str, bins: int = 5) -> DataFrame:
    """Late rate with observed range by equal-count band of an attribute."""
    known = df.where(F.col("late").isNotNull() & F.col(attribute).isNotNull())
    code = qcut_code(attribute, quantile_edges(known, attribute, bins)) + 1
    return known.withColumn("band", code).groupBy("band").agg(
        n_rows("orders"), F.avg("late").alias("late_rate"), F.min(attribute).alias("low"), F.max(attribute).alias("high"))


def review_group_late(df: DataFrame, with_missing: bool = False) -> DataFrame:
    band = cut_right_closed("review_score", REVIEW_EDGES, REVIEW_LABELS)
    if with_missing:
        band = F.coalesce(band, F.lit("No review"))
    return df.withColumn("review_group", band).where("late IS NOT NULL AND review_group IS NOT NULL") \
        .groupBy("review_group").agg(n_rows("orders"), F.sum(F.col("late").cast("bigint")).alias("late")) \
        .withColumn("late_rate_pct", percent("late", "orders"))


def review_kpis(df: DataFrame) -> DataFrame:
    low = F.col("review_score") <= 2
    seen = F.col("review_score").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return df.agg(F.count_if(seen).alias("reviewed"), F.avg(F.when(seen, yes(low))).alias("low_share"),
                  F.avg(F.when(seen, yes(F.col("has_review_comment")))).alias("comment_share"),
                  F.avg(F.when(low & F.col("late").isNotNull(), yes(F.col("late") == 0))).alias("on_time_among_low"))


def kpi_cards(df: DataFrame) -> DataFrame:
    """Headline figures; distinct customers are counted through a per-customer reduction."""
    per = df.groupBy("customer_id").agg(
        n_rows("o"), F.sum("order_value").alias("v"), F.count("late").alias("k"),
        F.sum(F.col("late").cast("bigint")).alias("l"), F.sum("review_score").alias("s"), F.count("review_score").alias("r"))
    return per.agg(F.sum("o").alias("orders"), F.count("customer_id").alias("customers"), F.sum("v").alias("value"),
                   ratio(F.sum("l"), F.sum("k")).alias("late_rate"), ratio(F.sum("s"), F.sum("r")).alias("mean_score"))


def seller_performance(history: DataFrame, min_orders: int) -> DataFrame:
    return history.groupBy("seller_id").agg(
        n_rows("orders"), F.avg("late").alias("late_rate"), F.median("deviation_days").alias("median_deviation")) \
        .where(F.col("orders") >= min_orders)


def seller_bands(history: DataFrame) -> DataFrame:
    """Late rate by prior volume and by past late rate of the seller."""
    volume = history.withColumn("band", cut_left_closed("prior_completed_orders", EXPERIENCE_EDGES, EXPERIENCE_LABELS))
    record = history.withColumn("band", F.coalesce(cut_left_closed("prior_late_rate", TRACK_EDGES, TRACK_LABELS),
                                                   F.lit("No history")))
    tag = lambda df, name: late_rate_by(df, "band").select(F.lit(name).alias("view"), "band", "orders", "late_rate")
    return tag(volume, "experience").unionByName(tag(record, "track record"))


def cross_state_topk(star: DataFrame, k: int) -> DataFrame:
    """Top-k categories per customer state, with quantity per customer of the state."""
    known = star.where("category IS NOT NULL AND customer_state IS NOT NULL")
    counts = known.groupBy("customer_state", "category").agg(n_rows("quantity"))
    w = Window.partitionBy("customer_state").orderBy(F.desc("quantity"), "category")
    buyers = known.select("customer_state", "customer_id").distinct().groupBy("customer_state").agg(n_rows("buyers"))
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k) \
        .join(buyers, "customer_state").withColumn("per_buyer", ratio("quantity", "buyers"))


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return wide.selectExpr(f"stack({len(pairs)}, {cells}) AS (left_col, right_col, pearson)")


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sd, min, exact percentiles and max per column."""
    q = exact_quantiles(df, by, columns, {"p5": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95, "p99": .99})
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    m = df.selectExpr(*by, f"stack({len(columns)}, {pairs}) AS (variable, value)").groupBy(*by, "variable").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    return q.join(m, [*by, "variable"])


def skewness_table(df: DataFrame, columns: Sequence[str], limit: float = 1.0) -> DataFrame:
    """Adjusted Fisher-Pearson skew before and after log1p."""
    parts = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        parts += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"m{i}"), F.skewness(x).alias(f"s{i}"),
                  F.skewness(F.log1p(F.when(x >= 0, x))).alias(f"l{i}")]
    wide = df.agg(*parts)
    cells = ", ".join(f"'{c}', n{i}, m{i}, s{i}, l{i}" for i, c in enumerate(columns))
    long = wide.selectExpr(f"stack({len(columns)}, {cells}) AS (feature, n, min, skew, skew_log)")
    n = F.col("n").cast("double")
    adjust = F.sqrt(n * (n - 1)) / (n - 2)
    ok = F.col("min") >= 0
    return long.select("feature", "min", (F.col("skew") * adjust).alias("skew_raw"),
                       F.when(ok, F.col("skew_log") * adjust).alias("skew_log1p"), ok.alias("non_negative"),
                       (ok & (F.abs(F.col("skew") * adjust) > limit)).alias("log1p_recommended"))


def numeric_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, p01, p99, median and inferred kind per column."""
    q = exact_quantiles(df, [], columns, {"min": 0, "p01": .01, "median": .5, "p99": .99, "max": 1})
    name = F.col("variable")
    kind = F.when(name.startswith("is_"), "binary").when(
        name.endswith("_count") | name.startswith("order_approved_")
        | name.isin("payment_installments_max", "orders_approved_prev_7d", "promised_lead_days"), "integer").otherwise("continuous")
    return q.withColumn("kind", kind)


def category_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted levels and the most frequent level (ties: first in order) per categorical."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    counts = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (feature, level)").where("level IS NOT NULL") \
        .groupBy("feature", "level").agg(n_rows("n"))
    return counts.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("level")), "|").alias("levels"),
                                         F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("mode"))


def score_histogram(df: DataFrame, score: str, bins: int = 30) -> DataFrame:
    low, high = df.agg(F.min(score), F.max(score)).first()
    width = (high - low) / bins
    return df.where(F.col(score).isNotNull()).groupBy(equal_width_bin(score, low, high, bins).alias("bin")) \
        .agg(n_rows("orders")).withColumn("lower", F.lit(low) + F.col("bin") * F.lit(width))


def trimmed_histogram(df: DataFrame, c: str) -> DataFrame:
    """Whole-number histogram within the 1st-99th percentile, with the sign side."""
    lo, hi = quantile_values(df, c, [0.01, 0.99])
    return df.where(F.col(c).between(lo, hi)).groupBy(F.ceil(c).cast("int").alias("days")).agg(n_rows("orders")) \
        .withColumn("side", F.when(F.col("days") > 0, "Late").otherwise("On time or early"))


def residuals_by_segment(df: DataFrame, segment: str, actual: str, predicted: str) -> DataFrame:
    e = col(predicted) - col(actual)
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(segment).agg(
        n_rows("n"), F.avg(actual).alias("mean_actual"), F.avg(predicted).alias("mean_predicted"),
        F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"))


def top_n(df: DataFrame, metric: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(metric), *ties).limit(n)


def mom_yoy(monthly: DataFrame, value: str) -> DataFrame:
    """Change against the previous and the twelfth previous row of a monthly series."""
    w = Window.orderBy("approved_month")
    def change(k):
        return ratio(F.col(value), F.lag(value, k).over(w)) - 1
    return monthly.select("approved_month", value, change(1).alias("mom"), change(12).alias("yoy"))
