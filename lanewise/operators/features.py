"""Order-grain, approval-time features.

Each rollup reduces its child table to one row per order before it is joined, so
no join multiplies rows, and all joins share the ``order_id`` partitioning.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import differs, ratio, sum0
from ..functions.scalars import flag, haversine_km, iso_week_capped, iso_weekday
from ..functions.times import calendar_days, day, elapsed_days, elapsed_hours, month_label
from ..session import shuffle_partitions
from .ordering import exact_quantiles

# The published feature contract (names and campaign window).
CAMPAIGN_PERIOD = ("2017-11-20", "2017-11-30")
CALENDAR_COLS = ["order_approved_day_of_week", "order_approved_day_of_month", "order_approved_month",
                 "order_approved_week_of_year"]
BASKET_COLS = ["order_item_count", "order_seller_count", "order_pdt_price_sum", "order_frieght_value_sum",
               "order_revenue_sum", "order_product_weight_g_sum", "order_product_category_count"]
DISTANCE_COLS = ["seller_dist_km_max", "seller_dist_km_min", "seller_dist_km_median", "seller_dist_km_mean"]
PLACE_COUNT_COLS = ["seller_zip_code_prefix_count", "seller_city_count", "seller_state_count"]
EXTRA_COLS = ["promised_lead_days", "approval_lag_hours", "order_product_volume_cm3_sum",
              "order_product_photos_mean", "freight_to_price_ratio", "payment_installments_max",
              "is_weekend_approval", "is_black_friday_period", "is_december_peak", "orders_approved_prev_7d"]
# Kind of each number; all others are measures that cannot be negative.
NUMBER_KINDS = {**dict.fromkeys(CALENDAR_COLS, "calendar bound"),
                **dict.fromkeys(["is_weekend_approval", "is_black_friday_period", "is_december_peak"], "flag"),
                **dict.fromkeys(["order_item_count", "order_seller_count", "order_product_category_count", "seller_state_count",
                                 "payment_installments_max"], "count"),
                "orders_approved_prev_7d": "count from zero", "promised_lead_days": "whole number"}
CATEGORICAL_COLS = ["customer_state", "route_type", "payment_combination"]
LEAKAGE_COLS = ["carrier_at", "delivered_at", "durn_to_carrier_days", "durn_to_customer_days", "order_status"]


def payment_cols(types: Sequence[str]) -> list[str]:
    return [f"payment_type_{kind}_{t}" for kind in ("value", "count") for t in types]


def numeric_cols(types: Sequence[str]) -> list[str]:
    return (CALENDAR_COLS + BASKET_COLS + DISTANCE_COLS + PLACE_COUNT_COLS + ["payment_value_sum"]
            + payment_cols(types) + EXTRA_COLS)


# The fixed reduction: one representative stays per group of overlapping measures.
SELECTED_NUMERIC = ["order_approved_day_of_week", "order_approved_day_of_month", "order_approved_month",
                    "order_item_count", "order_seller_count", "order_frieght_value_sum",
                    "order_product_weight_g_sum", "order_product_category_count", "seller_dist_km_mean",
                    "seller_state_count", "payment_value_sum"] + EXTRA_COLS


def assert_no_leakage(columns: Sequence[str]) -> None:
    bad = set(columns) & set(LEAKAGE_COLS)
    if bad:
        raise ValueError(f"outcome columns used as predictors: {sorted(bad)}")


def calendar_features(df: DataFrame) -> DataFrame:
    d = day("approved_at")
    return (df.withColumn("approved_day", d)
            .withColumn("order_approved_day_of_week", iso_weekday(d))
            .withColumn("order_approved_day_of_month", F.dayofmonth(d))
            .withColumn("order_approved_month", F.month(d))
            .withColumn("order_approved_week_of_year", iso_week_capped(d))
            .withColumn("partition_yyyymm", month_label(d)))


def duration_features(df: DataFrame) -> DataFrame:
    return (df.withColumn("durn_to_carrier_days", elapsed_days("carrier_at", "approved_at"))
            .withColumn("durn_to_customer_days", elapsed_days("delivered_at", "approved_at")))


def calendar_flags(df: DataFrame) -> DataFrame:
    d = day("approved_at")
    lo, hi = (F.lit(x).cast("date") for x in CAMPAIGN_PERIOD)
    return (df.withColumn("is_weekend_approval", flag(F.weekday(d) >= 5))
            .withColumn("is_black_friday_period", flag(d.between(lo, hi)))
            .withColumn("is_december_peak", flag(F.month(d) == 12)))


def promise_features(df: DataFrame) -> DataFrame:
    return (df.withColumn("promised_lead_days", calendar_days("estimated_at", "approved_at"))
            .withColumn("approval_lag_hours", elapsed_hours("approved_at", "purchase_ts")))


def lead_time_decomposition(df: DataFrame) -> DataFrame:
    """Stage lengths on calendar dates and, where it matters, floored elapsed days."""
    from ..functions.times import floored_days
    return (df.withColumn("purchase_to_approval_days", calendar_days("approved_at", "purchase_ts"))
            .withColumn("approval_to_carrier_days", calendar_days("carrier_at", "approved_at"))
            .withColumn("carrier_to_customer_days", calendar_days("delivered_at", "carrier_at"))
            .withColumn("deviation_days", calendar_days("delivered_at", "estimated_at"))
            .withColumn("actual_lead_floor", floored_days("delivered_at", "approved_at"))
            .withColumn("estimated_lead_floor", floored_days("estimated_at", "approved_at"))
            .withColumn("error_days_floor", F.col("actual_lead_floor") - F.col("estimated_lead_floor")))


def valid_target(df: DataFrame) -> DataFrame:
    """Delivered-only target: deviation days and late 0/1, missing without a valid outcome."""
    dev = calendar_days("delivered_at", "estimated_at")
    ok = (F.col("order_status") == "delivered") & dev.isNotNull()
    return (df.withColumn("deviation_days", dev).withColumn("valid_target", F.coalesce(ok, F.lit(False)))
            .withColumn("late", F.when(ok, (dev > 0).cast("int"))))


def route_type(orders: DataFrame, items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Item-based route class; an order without items (or places) counts as interstate."""
    known = (items.select("order_id", "seller_id").join(sellers.select("seller_id", "seller_state"), "seller_id", "left")
             .groupBy("order_id", "seller_state").agg(F.count(F.lit(1)).alias("_c")))
    legs = orders.select("order_id", "customer_state").join(known, "order_id", "left") \
        .withColumn("_x", differs("customer_state", "seller_state"))
    return legs.groupBy("order_id").agg(F.bool_and("_x").alias("_all"), F.bool_or("_x").alias("_any")).select(
        "order_id", F.when(F.col("_all"), "1. All interstate").when(~F.col("_any"), "2. All same-state")
        .otherwise("3. Mixed").alias("route_type"))


def route_type_legs(orders: DataFrame, items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Leg-based route class over distinct sellers; missing for an order without items."""
    legs = (items.select("order_id", "seller_id").distinct()
            .join(sellers.select("seller_id", "seller_state"), "seller_id", "left")
            .join(orders.select("order_id", "customer_state"), "order_id", "left"))
    same = F.count_if(F.col("seller_state") == F.col("customer_state"))
    return legs.groupBy("order_id").agg(F.count("seller_id").alias("legs"), same.alias("same")).select(
        "order_id", F.col("legs").alias("route_legs"), F.col("same").alias("same_state_legs"),
        F.when(F.col("same") == F.col("legs"), "All same-state").when(F.col("same") == 0, "All interstate")
        .otherwise("Mixed").alias("route_type"))


def geo_median_by_zip(geolocation: DataFrame, bounded: bool = False) -> DataFrame:
    """Exact median coordinate per zip, safe for a zip with any share of the readings."""
    geo = geo_bbox(geolocation) if bounded else geolocation
    med = exact_quantiles(geo, ["zip"], ["lat", "lng"], {"mid": 0.5})
    return med.groupBy("zip").agg(F.max(F.when(F.col("variable") == "lat", F.col("mid"))).alias("lat"),
                                  F.max(F.when(F.col("variable") == "lng", F.col("mid"))).alias("lng"))


def geo_bbox(geolocation: DataFrame) -> DataFrame:
    return geolocation.where(F.col("lat").between(-34, 6) & F.col("lng").between(-74, -34))


def pair_distances(items: DataFrame, orders: DataFrame, customers: DataFrame, sellers: DataFrame,
                   zips: DataFrame) -> DataFrame:
    """Distance of every distinct order-seller pair.

    The distance depends only on the two zips, so it is looked up per zip pair after
    the coordinates join each (much smaller) party table.
    """
    def located(df, key, zip_col, p):
        return df.select(key, zip_col).join(zips.select(F.col("zip").alias(zip_col), F.col("lat").alias(f"{p}_lat"),
                                                        F.col("lng").alias(f"{p}_lng")), zip_col, "left").drop(zip_col)
    pairs = (items.select("order_id", "seller_id").distinct()
             .join(located(sellers, "seller_id", "seller_zip", "s"), "seller_id", "left")
             .join(orders.select("order_id", "customer_id"), "order_id", "left")
             .join(located(customers, "customer_id", "customer_zip", "c"), "customer_id", "left"))
    return pairs.select("order_id", "seller_id",
                        haversine_km("s_lat", "s_lng", "c_lat", "c_lng").alias("distance_km"))


def seller_distance_stats(pairs: DataFrame) -> DataFrame:
    """Per-order distance summary; distances repeat per zip, so they are counted per distinct value."""
    return pairs.groupBy("order_id").agg(
        F.max("distance_km").alias("seller_dist_km_max"), F.min("distance_km").alias("seller_dist_km_min"),
        F.median("distance_km").alias("seller_dist_km_median"), F.avg("distance_km").alias("seller_dist_km_mean"),
        F.count("seller_id").alias("seller_dist_km_count"))


def category_sets(items: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct categories per order: repeats collapse before the set is gathered."""
    seen = items.select("order_id", "product_id").join(products.select("product_id", "category"), "product_id") \
        .where("category IS NOT NULL").select("order_id", "category").distinct()
    return seen.groupBy("order_id").agg(F.array_sort(F.collect_set("category")).alias("product_categories"))


def order_item_rollup(items: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """Basket measures and place sets per order.

    Two levels, (order, seller) then order: seller attributes join the reduced rows,
    every distinct count is the size of a set of places or categories, and no
    multi-distinct expansion is needed.
    """
    by_pair = (items.join(products.select("product_id", "weight_g"), "product_id", "left")
               .groupBy("order_id", "seller_id").agg(
        F.count("product_id").alias("n"), sum0("price").alias("price"), sum0("freight_value").alias("freight"),
        sum0(F.col("price") + F.col("freight_value")).alias("revenue"), sum0("weight_g").alias("weight")))
    return (by_pair.join(sellers, "seller_id", "left").groupBy("order_id").agg(
        F.sum("n").alias("order_item_count"), F.count("seller_id").alias("order_seller_count"),
        F.sum("price").alias("order_pdt_price_sum"), F.sum("freight").alias("order_frieght_value_sum"),
        F.sum("revenue").alias("order_revenue_sum"), F.sum("weight").alias("order_product_weight_g_sum"),
        F.array_sort(F.collect_set("seller_zip")).alias("seller_zips"),
        F.array_sort(F.collect_set("seller_city")).alias("seller_cities"),
        F.array_sort(F.collect_set("seller_state")).alias("seller_states"))
        .join(category_sets(items, products), "order_id", "left")
        .withColumn("product_categories", F.coalesce("product_categories", F.array().cast("array<string>")))
        .withColumn("order_product_category_count", F.size("product_categories"))
        .withColumn("seller_zip_code_prefix_count", F.size("seller_zips"))
        .withColumn("seller_city_count", F.size("seller_cities"))
        .withColumn("seller_state_count", F.size("seller_states")))


def payment_aggs(types: Sequence[str]) -> list:
    def of(t):
        return F.col("payment_type") == t
    return [F.sum("payment_value").alias("payment_value_sum"),
            *[F.coalesce(F.sum(F.when(of(t), F.col("payment_value"))), F.lit(0.0)).alias(f"payment_type_value_{t}") for t in types],
            *[F.count_if(of(t)).alias(f"payment_type_count_{t}") for t in types]]


def profile_aggs() -> list:
    return [F.array_join(F.array_sort(F.collect_set("payment_type")), "+").alias("payment_combination"),
            F.max("installments").alias("payment_installments_max")]


def payment_pivot(payments: DataFrame, types: Sequence[str]) -> DataFrame:
    """Total plus value and count per known type, in one aggregation (no distinct-value pass)."""
    return payments.groupBy("order_id").agg(*payment_aggs(types))


def payment_profile(payments: DataFrame) -> DataFrame:
    """Distinct types joined by '+', and the largest number of installments."""
    return payments.groupBy("order_id").agg(*profile_aggs())


def volume_photos(items: DataFrame, products: DataFrame) -> DataFrame:
    dims = products.select("product_id", "photos", (F.col("length_cm") * F.col("height_cm") * F.col("width_cm"))
                           .cast("double").alias("volume"))
    return items.select("order_id", "product_id").join(dims, "product_id", "left").groupBy("order_id").agg(
        F.sum("volume").alias("order_product_volume_cm3_sum"), F.avg("photos").alias("order_product_photos_mean"))


def trailing_load(orders: DataFrame, days: int = 7) -> DataFrame:
    """Approvals in the completed days before each calendar day.

    Daily counts first, so the frame runs over one row per calendar day. A RANGE frame
    needs no dense calendar: absent days simply contribute nothing.
    """
    daily = orders.where("approved_at IS NOT NULL").groupBy(day("approved_at").alias("approved_day")).agg(
        F.count(F.lit(1)).alias("approved"))
    w = Window.orderBy(F.unix_date("approved_day")).rangeBetween(-days, -1)
    return daily.select("approved_day", "approved",
                        F.coalesce(F.sum("approved").over(w), F.lit(0)).alias("orders_approved_prev_7d"))


def primary_item(items: DataFrame, products: DataFrame, sellers: DataFrame, order: Sequence[str]) -> DataFrame:
    """First non-missing category and seller state by item sequence."""
    star = (items.join(products.select("product_id", "category"), "product_id", "left")
            .join(sellers.select("seller_id", "seller_state"), "seller_id", "left"))
    key = F.struct(*order)

    def first(c):
        return F.min_by(c, F.when(F.col(c).isNotNull(), key))
    return star.groupBy("order_id").agg(first("category").alias("primary_category"),
                                        first("seller_state").alias("primary_seller_state"))


def primary_payment(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.min_by("payment_type", F.struct("payment_seq", "payment_type")).alias("primary_payment_type"))


def ordered_join(df: DataFrame, key: str, value: str, sep: str = ", ") -> DataFrame:
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias("joined"))


def review_rollup(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(
        F.avg("score").alias("review_score"), F.min("score").alias("lowest_score"),
        F.max_by("score", F.struct("answered_at", "review_id")).alias("latest_score"),
        F.bool_or(F.col("comment").isNotNull()).alias("has_review_comment"))


DIMENSION_ROWS = 1_500_000  # a dimension of at most so many rows (some 100 bytes each) is broadcast
DEALT_ROWS = 250_000  # lines of a task: with all they look up (about 600 bytes each in a sort) they stay within its share of memory


def _by_order(*tables: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Lays out any of the tables by order, all alike. A task sorts its lines to gather their sets, so large tables are dealt in parts of
    about DEALT_ROWS rows of the largest one, however few shuffle partitions the session has; others in the session's own."""
    spark = tables[0].sparkSession
    parts = -(-max(t.count() for t in tables) // DEALT_ROWS)
    usual = parts <= min(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    return lambda df: df.repartition("order_id") if usual else df.repartition(parts, "order_id")


def _look_up(rows: DataFrame, dimensions: Sequence[tuple[DataFrame, str]], deal: Callable[[DataFrame], DataFrame],
             spent: Sequence[str] = ()) -> DataFrame:
    """Rows with the columns of each (table, key), laid out by order. Rows cross the network narrow: a small dimension is joined after they
    lie by order, a large one by a shuffle on its key before. Of a ``spent`` key only the presence is read later, so that its values stay behind."""
    small = [d.count() <= DIMENSION_ROWS for d, _ in dimensions]
    for (d, key), fits in zip(dimensions, small):
        rows = rows if fits else rows.join(d, key, "left")
        if key in spent and not fits:
            rows = rows.withColumn(key, F.when(F.col(key).isNotNull(), F.lit(0)))
    rows = deal(rows)
    for (d, key), fits in zip(dimensions, small):
        rows = rows.join(F.broadcast(d), key, "left") if fits else rows
    return rows


def basket_by_order(t, orders: DataFrame, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Basket, route, distance and catalogue features, one row per order.

    Lines are laid out by order once, with the columns of their product and seller, and reduced there (no partial aggregation of whole
    input splits before); distances and place sets come from the order's distinct sellers. Distances use every place of the order's buyer rows.
    Given ``deal``, ``orders`` lie by it already.
    """
    if deal is None:
        deal = _by_order(t.items, orders)
        orders = deal(orders.where("order_id IS NOT NULL").select("order_id", "customer_state", "customer_zip"))
    zips = geo_median_by_zip(t.geolocation)

    def place(df, p):
        # One row per place: bounded by the map.
        return df.join(F.broadcast(zips.select(F.col("zip").alias(f"{p}_zip"), F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"))),
                       f"{p}_zip", "left")
    catalogue = t.products.select("product_id", "weight_g", "photos", "category",
                                  (F.col("length_cm") * F.col("height_cm") * F.col("width_cm")).cast("double").alias("volume"))
    sellers = place(t.sellers, "seller").select("seller_id", "seller_zip", "seller_city", "seller_state", "seller_lat", "seller_lng")
    # Rows that repeat a seller stay apart.
    sellers = sellers.withColumn("_copy", F.row_number().over(Window.partitionBy("seller_id").orderBy(*[c for c in sellers.columns if c != "seller_id"])))
    lines = _look_up(t.items.where("order_id IS NOT NULL").select("order_id", "product_id", "seller_id", "price", "freight_value"),
                     [(catalogue, "product_id"), (sellers, "seller_id")], deal, spent=["product_id"])
    sums = lines.groupBy("order_id").agg(
        F.count("product_id").alias("n"), sum0("price").alias("price"), sum0("freight_value").alias("freight"),
        sum0(F.col("price") + F.col("freight_value")).alias("revenue"), sum0("weight_g").alias("weight"), F.sum("volume").alias("volume"),
        F.sum("photos").alias("photos"), F.count("photos").alias("photographed"), F.collect_set("category").alias("_categories"),
        F.collect_set(F.struct("seller_id", *[c for c in sellers.columns if c != "seller_id"])).alias("_legs"))
    buyers = place(orders.where("order_id IS NOT NULL").select("order_id", "customer_state", "customer_zip"), "customer") \
        .groupBy("order_id").agg(F.collect_list(F.struct("customer_state", "customer_lat", "customer_lng")).alias("_homes"))

    def pairs(of):
        return F.flatten(F.transform("_homes", lambda h: F.transform("_legs", lambda l: of(l, h))))
    km = pairs(lambda l, h: haversine_km(l["seller_lat"], l["seller_lng"], h["customer_lat"], h["customer_lng"]))
    far = pairs(lambda l, h: differs(h["customer_state"], l["seller_state"]))
    times = F.size("_homes")

    def places(c):
        return F.array_sort(F.array_distinct(F.array_compact(F.col(f"_legs.{c}"))))
    # Each array is made once: the next step reads it as a column.
    made = sums.join(buyers, "order_id").select(
        "order_id", (F.col("n") * times).alias("order_item_count"), (F.size(F.array_compact("_legs.seller_id")) * times).cast("long").alias("order_seller_count"),
        (F.col("price") * times).alias("order_pdt_price_sum"), (F.col("freight") * times).alias("order_frieght_value_sum"),
        (F.col("revenue") * times).alias("order_revenue_sum"), (F.col("weight") * times).alias("order_product_weight_g_sum"),
        (F.col("volume") * times).alias("order_product_volume_cm3_sum"), ratio("photos", "photographed").alias("order_product_photos_mean"),
        places("seller_zip").alias("seller_zips"), places("seller_city").alias("seller_cities"), places("seller_state").alias("seller_states"),
        F.array_sort("_categories").alias("product_categories"), F.array_sort(F.array_compact(km)).alias("_km"), F.array_distinct(far).alias("_far"))
    n = F.size("_km")

    def at(place):
        return F.get("_km", place.cast("int"))  # missing for an order without distances
    return made.select(
        "*", at(n - 1).alias("seller_dist_km_max"), at(F.lit(0)).alias("seller_dist_km_min"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("seller_dist_km_median"),
        ratio(F.aggregate("_km", F.lit(0.0), lambda a, x: a + x), n).alias("seller_dist_km_mean"),
        F.array_min("_far").alias("_all"), F.array_max("_far").alias("_any"), F.size("product_categories").alias("order_product_category_count"),
        F.size("seller_zips").alias("seller_zip_code_prefix_count"), F.size("seller_cities").alias("seller_city_count"),
        F.size("seller_states").alias("seller_state_count")).drop("_km", "_far")


def feature_table(t, payment_types: Sequence[str], min_month: str = "1995-02") -> DataFrame:
    """One row per approved order: item and payment rollups merged, plus the extra columns.

    Passes over the child tables (items, payments), each laid out by order and reduced to one row per order
    before it joins; every large join shares the ``order_id`` partitioning. Derived columns are made after the last join.
    """
    deal = _by_order(t.items, t.payments, t.orders)
    approved = t.orders.where(F.col("approved_at").isNotNull() & (month_label("approved_at") >= min_month))
    orders = _look_up(approved, [(t.customers, "customer_id")], deal)
    pay = deal(t.payments.where("order_id IS NOT NULL")).groupBy("order_id").agg(*payment_aggs(payment_types), *profile_aggs())
    load = trailing_load(t.orders).drop("approved")
    df = duration_features(calendar_features(orders.join(basket_by_order(t, orders, deal), "order_id", "left").join(pay, "order_id", "left")))
    df = df.join(F.broadcast(load), "approved_day", "left")
    df = calendar_flags(promise_features(df))
    route = F.when(F.coalesce("_all", F.lit(True)), "1. All interstate").when(~F.col("_any"), "2. All same-state").otherwise("3. Mixed")
    return (df.withColumn("route_type", route).drop("_all", "_any")
            .withColumn("payment_combination", F.coalesce("payment_combination", F.lit("no_payment")))
            .withColumn("freight_to_price_ratio", ratio("order_frieght_value_sum", "order_pdt_price_sum")))


def order_outcomes(t, features: DataFrame, item_order: Sequence[str], first_month: str, last_month: str,
                   lookback: int = 45) -> DataFrame:
    """Wide descriptive order table: features, label, target, first item and review.

    Label and target read the order's own dates, so no second pass over orders is needed.
    """
    from ..functions.bands import REVIEW_EDGES, REVIEW_LABELS, cut_right_closed
    from .labels import EXCLUDED_STATUSES, cancel_override, labels_as_of, targets_as_of
    run = F.date_add(day("approved_at"), lookback + 1)
    df = features.where(F.col("partition_yyyymm").between(first_month, last_month))
    df = targets_as_of(labels_as_of(df, run), run, lookback)
    df = cancel_override(df.withColumnRenamed("label", "late"), "late")
    gone = F.col("order_status").isin(EXCLUDED_STATUSES)
    df = (df.withColumn("days_from_promise", F.when(~gone, F.col("target")))
          .join(primary_item(t.items, t.products, t.sellers, item_order), "order_id", "left")
          .join(review_rollup(t.reviews), "order_id", "left"))
    return df.select(
        "order_id", "customer_id", "approved_day", F.trunc("approved_day", "MM").alias("approved_month"),
        iso_weekday("purchase_ts").alias("purchase_weekday"), F.hour("purchase_ts").alias("purchase_hour"),
        "order_status", "customer_state", "route_type", "seller_dist_km_mean",
        F.col("order_item_count").alias("item_count"), F.col("order_seller_count").alias("seller_count"),
        F.col("order_product_category_count").alias("category_count"),
        F.col("order_pdt_price_sum").alias("order_value"), F.col("order_frieght_value_sum").alias("freight_value"),
        F.col("payment_value_sum").alias("payment_value"), "payment_combination", "payment_installments_max",
        "promised_lead_days", "approval_lag_hours",
        F.col("durn_to_carrier_days").alias("approval_to_carrier_days"),
        F.col("durn_to_customer_days").alias("approval_to_customer_days"),
        "primary_category", "primary_seller_state", "review_score", "has_review_comment",
        "late", "label_status", "days_from_promise",
        cut_right_closed("review_score", REVIEW_EDGES, REVIEW_LABELS).alias("review_group"))
