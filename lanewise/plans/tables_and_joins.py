"""Sources, sinks, row expressions and joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.nulls import ratio
from ..functions.times import calendar_days, day, elapsed_days
from ..operators import asof, audits, contract, cubes, features, history, joins, ordering
from ..operators.labels import labels_as_of
from ..session import shared_path
from ..sources import snapshots, tables
from .catalog import FIRST_MONTH, LAST_MONTH, RUN_DATE, query
from .oracle import label

RUN_SQL = "DATE '1998-06-02'"


@query("late_rate_as_known", f"""SELECT strftime(approved_at, '%Y-%m') AS month, count(*) AS orders,
    round(avg(y), 6) AS late_rate FROM (SELECT approved_at, {label(RUN_SQL)} AS y FROM r_orders) WHERE y IS NOT NULL GROUP BY 1""")
def _(t):
    known = labels_as_of(t.orders, RUN_DATE).where("label IS NOT NULL")
    return known.groupBy(F.date_format(day("approved_at"), "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.avg("label").alias("late_rate"))


# ---- sources and sinks ----

@query("load_tables", """SELECT 'orders' AS role, count(*) AS rows, count(approved_at) AS dated FROM r_orders
    UNION ALL SELECT 'items', count(*), count(shipping_limit) FROM r_items
    UNION ALL SELECT 'reviews', count(*), count(answered_at) FROM r_reviews""")
def _(t):
    part = lambda role, df, c: df.agg(F.count(F.lit(1)).alias("rows"), F.count(c).alias("dated")).select(
        F.lit(role).alias("role"), "rows", "dated")
    return audits.union_all([part("orders", t.orders, "approved_at"), part("items", t.items, "shipping_limit"),
                             part("reviews", t.reviews, "answered_at")])


@query("translate_dimension", """SELECT product_id, coalesce(category_english, p.category, 'Unknown') AS category_label
    FROM r_products p LEFT JOIN r_translation USING (category)""")
def _(t):
    return tables.translate_dimension(t.products, t.translation).select("product_id", "category_label")


@query("scan_subset_columns", "SELECT c_nationkey AS zip, count(*) AS readings FROM customer GROUP BY 1")
def _(t):
    return t.raw("customer").select(F.col("c_nationkey").alias("zip")).groupBy("zip").agg(F.count(F.lit(1)).alias("readings"))


@query("json_snapshot_source", """SELECT approved_at::DATE AS approval_day, count(*) AS orders,
    round(avg(date_diff('day', approved_at::DATE, estimated_at::DATE)), 6) AS mean_promise
    FROM r_orders WHERE approved_at IS NOT NULL GROUP BY 1""")
def _(t):
    """Written as one JSON document per day, read back through the nested reader."""
    path = shared_path(t.spark, "day-json")
    rows = t.orders.where("approved_at IS NOT NULL").select(
        day("approved_at").alias("d"), "order_id", calendar_days("estimated_at", "approved_at").alias("promise"))
    # One document per day and 10,000 orders: a busy day becomes several bounded documents.
    ranked = ordering.global_rank(rows, [F.asc("order_id")], ["d"])
    docs = ranked.groupBy("d", F.floor((F.col("rank") - 1) / 10_000).alias("slice")).agg(
        F.collect_list(F.struct("order_id", "promise")).alias("rows")).select(F.map_from_arrays(
            F.array(F.date_format("d", "yyyy-MM-dd")), F.array("rows")).alias("days"))
    docs.write.json(path)
    back = snapshots.read_day_json(t.spark, path, "struct<order_id: bigint, promise: int>", lines=True)
    return back.groupBy("approval_day").agg(F.count("order_id").alias("orders"), F.avg("promise").alias("mean_promise"))


@query("json_month_inputs", f"""WITH b AS (SELECT strftime(approved_at, '%Y-%m') AS month, p, days, {label(f"DATE '{RUN_DATE}'")} AS y, date_diff('day', estimated_at::DATE, delivered_at::DATE) AS gone
      FROM r_orders LEFT JOIN r_scores USING (order_id) WHERE approved_at IS NOT NULL)
    SELECT month, count(*) AS orders, count(p) AS scored, count(y) AS known, sum(y)::BIGINT AS late, round(avg(p), 6) AS mean_p, round(avg(abs(days - gone)), 6) AS mean_abs_days FROM b GROUP BY 1""")
def _(t):
    """Scores, outcomes and actual days from the promise, written as keyed JSON and joined back as a month-end review reads them."""
    orders = labels_as_of(t.orders.where("approved_at IS NOT NULL"), RUN_DATE).join(t.scores, "order_id", "left")
    paths = {field: shared_path(t.spark, field) for field in ("scores", "outcomes", "actual_days_from_promise")}
    values = {"scores": F.when(F.col("p").isNotNull(), F.array("p", "days")), "outcomes": F.col("label"),
              "actual_days_from_promise": calendar_days("delivered_at", "estimated_at")}
    for field, value in values.items():
        snapshots.write_keyed_json(orders, paths[field], field, "order_id", value)
    read = lambda field, name: snapshots.read_keyed_json(t.spark, paths[field], field, "int", lines=True).withColumnRenamed("value", name)
    months = t.orders.select(F.col("order_id").cast("string").alias("order_id"), F.date_format("approved_at", "yyyy-MM").alias("month"))
    back = months.join(snapshots.read_score_json(t.spark, paths["scores"], lines=True), "order_id") \
        .join(read("outcomes", "y"), "order_id").join(read("actual_days_from_promise", "gone"), "order_id")
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("orders"), F.count("p").alias("scored"), F.count("y").alias("known"), F.sum("y").alias("late"),
                                     F.avg("p").alias("mean_p"), F.avg(F.abs(F.col("days") - F.col("gone"))).alias("mean_abs_days"))


@query("write_parquet_eda", "SELECT count(*) AS rows, count(late) AS known, sum(late)::BIGINT AS late FROM ot")
def _(t):
    path = shared_path(t.spark, "orders")
    tables.write_parquet(t.order_table, path, ["approved_month"])
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.count("late").alias("known"),
                                          F.sum(F.col("late").cast("bigint")).alias("late"))


@query("write_daily_snapshots", f"""SELECT f.approved_day AS approval_day, count(*) AS orders, count(y) AS known,
    sum(order_item_count)::BIGINT AS items FROM feat f JOIN (SELECT order_id, {label('(approved_at::DATE + 46)')} AS y
    FROM r_orders) o USING (order_id) GROUP BY 1""")
def _(t):
    path = shared_path(t.spark, "snapshots")
    cols = ["order_item_count", "promised_lead_days", "customer_state"]
    snap = snapshots.daily_snapshots(t.features, cols)
    outcome = labels_as_of(t.orders.where("approved_at IS NOT NULL AND date_format(approved_at, 'yyyy-MM') >= '1995-02'"),
                           F.date_add(day("approved_at"), 46)).select(
        day("approved_at").alias("approval_day"), "order_id", "label")
    snapshots.write_daily_snapshots(snap, outcome, path)
    a = t.spark.read.parquet(f"{path}/snapshots").groupBy("approval_day").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("features.order_item_count").alias("items"))
    b = t.spark.read.parquet(f"{path}/outcomes").groupBy("approval_day").agg(F.count("label").alias("known"))
    return a.join(b, "approval_day").select("approval_day", "orders", "known", F.coalesce("items").alias("items"))


@query("write_csv_tables", "SELECT customer_state, count(*) AS orders, round(avg(late), 6) AS late_rate FROM ot WHERE late IS NOT NULL GROUP BY 1")
def _(t):
    path = shared_path(t.spark, "csv")
    table = cubes.late_rate_by(t.order_table, "customer_state")
    tables.write_csv(table, path)
    return t.spark.read.schema("customer_state string, orders bigint, late_rate double").option("header", True).csv(path)


@query("round_trip_read", "SELECT count(*) AS rows, 0::BIGINT AS changed, round(sum(price), 2) AS total FROM r_items", digits=2)
def _(t):
    """Doubles written as text read back to the same bits."""
    path = shared_path(t.spark, "text")
    src = t.items.select("price", "freight_value", F.hash("price", "freight_value").alias("h"))
    src.write.option("header", True).csv(path)
    back = t.spark.read.schema("price double, freight_value double, h int").option("header", True).csv(path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.hash("price", "freight_value") != F.col("h")).alias("changed"),
                    F.sum("price").alias("total"))


@query("batch_input_csv", """SELECT order_id::VARCHAR AS order_id, product_category AS customer_state,
    CASE WHEN order_id % 7 <> 0 THEN promise::DOUBLE END AS promised_lead_days FROM (SELECT order_id, customer_state AS product_category,
    date_diff('day', approved_at::DATE, estimated_at::DATE) AS promise FROM f_approved)""")
def _(t):
    path = shared_path(t.spark, "upload")
    rows = t.orders.where("approved_at IS NOT NULL").join(t.customers, "customer_id", "left").select(
        "order_id", "customer_state",
        F.when(F.col("order_id") % 7 != 0, calendar_days("estimated_at", "approved_at")).alias("promised_lead_days"))
    rows.write.option("header", True).csv(path)
    return tables.batch_input_csv(t.spark, path, ["customer_state", "promised_lead_days"], categorical=["customer_state"])


@query("table_fingerprint")
def _(t):
    parts = [tables.table_fingerprint(df).select(F.lit(n).alias("table_name"), "*")
             for n, df in (("orders", t.orders), ("items", t.items), ("customers", t.customers))]
    return audits.union_all(parts)


# ---- row expressions ----

CAL = """isodow(approved_day) AS order_approved_day_of_week, day(approved_day) AS order_approved_day_of_month,
    month(approved_day) AS order_approved_month, least(weekofyear(approved_day), 52) AS order_approved_week_of_year,
    partition_yyyymm"""


@query("calendar_features", f"SELECT order_id, {CAL} FROM f_approved")
def _(t):
    return features.calendar_features(t.orders.where("approved_at IS NOT NULL")).select(
        "order_id", *features.CALENDAR_COLS, "partition_yyyymm")


@query("duration_features", """SELECT order_id, round((epoch_us(carrier_at) - epoch_us(approved_at)) / 86400000000.0::DOUBLE, 6) AS durn_to_carrier_days,
    round((epoch_us(delivered_at) - epoch_us(approved_at)) / 86400000000.0::DOUBLE, 6) AS durn_to_customer_days FROM r_orders""")
def _(t):
    return features.duration_features(t.orders).select("order_id", "durn_to_carrier_days", "durn_to_customer_days")


@query("promised_lead_days", "SELECT order_id, date_diff('day', approved_at::DATE, estimated_at::DATE) AS promised_lead_days FROM r_orders")
def _(t):
    return features.promise_features(t.orders).select("order_id", "promised_lead_days")


@query("approval_lag_hours", "SELECT order_id, round((epoch_us(approved_at) - epoch_us(purchase_ts)) / 3600000000.0::DOUBLE, 6) AS approval_lag_hours FROM r_orders")
def _(t):
    return features.promise_features(t.orders).select("order_id", "approval_lag_hours")


@query("safe_ratio", """SELECT order_id, item_seq, product_id, seller_id, round(freight_value / nullif(price, 0), 6) AS freight_to_price FROM r_items""")
def _(t):
    return t.items.select("order_id", "item_seq", "product_id", "seller_id", ratio("freight_value", "price").alias("freight_to_price"))


@query("calendar_flags", """SELECT order_id, (isodow(approved_day) >= 6)::BIGINT AS is_weekend_approval,
    (approved_day BETWEEN DATE '2017-11-20' AND DATE '2017-11-30')::BIGINT AS is_black_friday_period,
    (month(approved_day) = 12)::BIGINT AS is_december_peak FROM f_approved""")
def _(t):
    return features.calendar_flags(t.orders.where("approved_at IS NOT NULL")).select(
        "order_id", "is_weekend_approval", "is_black_friday_period", "is_december_peak")


@query("haversine_km", "SELECT order_id, seller_id, round(distance_km, 6) AS distance_km FROM f_pairs")
def _(t):
    return features.pair_distances(t.items, t.orders, t.customers, t.sellers, features.geo_median_by_zip(t.geolocation))


def _dd(a, b):
    return f"date_diff('day', {a}::DATE, {b}::DATE)"


def _fl(a, b):
    return f"floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0)::BIGINT"


@query("lead_time_decomposition", f"""SELECT order_id, {_dd('purchase_ts', 'approved_at')} AS purchase_to_approval_days,
    {_dd('approved_at', 'carrier_at')} AS approval_to_carrier_days, {_dd('carrier_at', 'delivered_at')} AS carrier_to_customer_days,
    {_dd('estimated_at', 'delivered_at')} AS deviation_days, {_fl('approved_at', 'delivered_at')} AS actual_lead_floor,
    {_fl('approved_at', 'estimated_at')} AS estimated_lead_floor,
    {_fl('approved_at', 'delivered_at')} - {_fl('approved_at', 'estimated_at')} AS error_days_floor FROM r_orders""")
def _(t):
    return features.lead_time_decomposition(t.orders).select(
        "order_id", "purchase_to_approval_days", "approval_to_carrier_days", "carrier_to_customer_days", "deviation_days",
        "actual_lead_floor", "estimated_lead_floor", "error_days_floor")


@query("valid_target_flag", f"""SELECT order_id, order_status = 'delivered' AND delivered_at IS NOT NULL AS valid_target,
    CASE WHEN order_status = 'delivered' AND delivered_at IS NOT NULL THEN (delivered_at::DATE > estimated_at::DATE)::BIGINT END AS late
    FROM r_orders""")
def _(t):
    return features.valid_target(t.orders).select("order_id", "valid_target", "late")


@query("dashboard_filter", """SELECT order_id, approved_day, customer_state, round(seller_dist_km_mean, 6) AS seller_dist_km_mean FROM ot
    WHERE approved_day BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND customer_state IN ('ASIA', 'EUROPE')
    AND order_status IN ('delivered') AND (seller_dist_km_mean BETWEEN 500 AND 2500 OR seller_dist_km_mean IS NULL)
    AND promised_lead_days BETWEEN 20 AND 29""")
def _(t):
    return cubes.dashboard_filter(
        t.order_table, ("1996-01-01", "1997-12-31"), members={"customer_state": ["ASIA", "EUROPE"], "order_status": ["delivered"]},
        ranges={"seller_dist_km_mean": (500, 2500), "promised_lead_days": (20, 29)}, include_missing=["seller_dist_km_mean"]) \
        .select("order_id", "approved_day", "customer_state", "seller_dist_km_mean")


@query("geo_bbox_filter", """SELECT zip, count(*) AS readings FROM r_geo WHERE lat BETWEEN -34 AND 6 AND lng BETWEEN -74 AND -34 GROUP BY 1""")
def _(t):
    return features.geo_bbox(t.geolocation).groupBy("zip").agg(F.count(F.lit(1)).alias("readings"))


@query("state_other_bucket", """WITH top AS (SELECT customer_state FROM f_approved WHERE customer_state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)
    SELECT CASE WHEN customer_state IN (SELECT customer_state FROM top) THEN customer_state ELSE 'Others' END AS state, count(*) AS orders FROM f_approved GROUP BY 1""")
def _(t):
    orders = joins.orders_with_customers(t.orders, t.customers).where("approved_at IS NOT NULL")
    return orders.groupBy(S.keep_top("customer_state", cubes.most_common(orders, "customer_state", 2)).alias("state")).agg(F.count(F.lit(1)).alias("orders"))


@query("route_label", r"""SELECT order_id, primary_seller_state || ' → ' || customer_state AS route,
    regexp_replace(route_type, '^\d+\.\s*', '') AS route_name FROM ot WHERE primary_seller_state IS NOT NULL""")
def _(t):
    return t.order_table.where("primary_seller_state IS NOT NULL").select(
        "order_id", S.route_label("primary_seller_state", "customer_state").alias("route"),
        S.strip_order_prefix("route_type").alias("route_name"))


@query("recode_map", """SELECT CASE label_status WHEN 'on_time_delivered' THEN 'Delivered on time' WHEN 'late_delivered' THEN 'Delivered late'
    WHEN 'late_undelivered' THEN 'Late, not delivered' WHEN 'unresolved' THEN 'Unresolved'
    WHEN 'canceled_or_unavailable' THEN 'Canceled or unavailable' ELSE 'Invalid dates' END AS outcome, count(*) AS orders
    FROM ot GROUP BY 1""")
def _(t):
    return t.order_table.groupBy(S.recode("label_status", cubes.STATUS_NAMES).alias("outcome")).agg(F.count(F.lit(1)).alias("orders"))


@query("log1p_cyclic_expand", """SELECT order_id, round(ln(1 + payment_value_sum), 6) AS log_payment_value_sum,
    round(ln(1 + approval_lag_hours), 6) AS log_approval_lag_hours,
    round(sin(2 * pi() * order_approved_month / 12), 6) + 0.0 AS order_approved_month_sin,
    round(cos(2 * pi() * order_approved_month / 12), 6) + 0.0 AS order_approved_month_cos,
    round(sin(2 * pi() * order_approved_day_of_week / 7), 6) + 0.0 AS order_approved_day_of_week_sin,
    round(cos(2 * pi() * order_approved_day_of_week / 7), 6) + 0.0 AS order_approved_day_of_week_cos,
    CASE route_type WHEN '3. Mixed' THEN '1. All interstate' ELSE route_type END AS route_type FROM feat""")
def _(t):
    from ..operators.design import expand
    df = expand(t.features, ["payment_value_sum", "approval_lag_hours", "order_approved_month", "order_approved_day_of_week"],
                log_cols=["payment_value_sum", "approval_lag_hours"], cyclic=True, merge_mixed_route=True)
    return df.select("order_id", "log_payment_value_sum", "log_approval_lag_hours", "order_approved_month_sin",
                     "order_approved_month_cos", "order_approved_day_of_week_sin", "order_approved_day_of_week_cos", "route_type")


PRED = """SELECT order_id, days, date_diff('day', approved_at::DATE, estimated_at::DATE) AS promised,
    CASE WHEN approved_at IS NULL OR days IS NULL THEN days
    ELSE greatest(least(days, 45 - date_diff('day', approved_at::DATE, estimated_at::DATE)), -date_diff('day', approved_at::DATE, estimated_at::DATE)) END AS clipped
    FROM r_orders JOIN r_scores USING (order_id)"""


def _clipped(t):
    df = t.orders.join(t.scores, "order_id").withColumn("promised", calendar_days("estimated_at", "approved_at"))
    return df.withColumn("clipped", S.clip_to_waiting_period("days", "promised", 45).cast("double"))


@query("waiting_period_clip", f"SELECT order_id, round(clipped::DOUBLE, 6) AS clipped FROM ({PRED})")
def _(t):
    return _clipped(t).select("order_id", "clipped")


@query("prediction_split", f"""SELECT order_id, CASE WHEN clipped IS NOT NULL THEN greatest(clipped, 0)::DOUBLE END AS late_by,
    CASE WHEN clipped IS NOT NULL THEN greatest(-clipped, 0)::DOUBLE END AS early_by, clipped <> days AS was_clipped FROM ({PRED})""")
def _(t):
    late, early = S.split_prediction("clipped")
    return _clipped(t).select("order_id", late.alias("late_by"), early.alias("early_by"),
                              (F.col("clipped") != F.col("days")).alias("was_clipped"))


DRIFT = ["seller_dist_km_mean", "payment_value_sum", "freight_to_price_ratio"]


@query("drift_flags", "WITH tr AS (SELECT * FROM feat WHERE partition_yyyymm < '1998-01'), r AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in DRIFT) + " FROM tr) "
    "SELECT order_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} < lo_{c} OR {c} > hi_{c} THEN '{c}' END" for c in DRIFT)
    + ") AS drifted FROM feat, r WHERE partition_yyyymm >= '1998-01'")
def _(t):
    ref = t.features.where("partition_yyyymm < '1998-01'")
    found = {r["variable"]: (r["lo"], r["hi"]) for r in
             ordering.exact_quantiles(ref, [], DRIFT, {"lo": 0.01, "hi": 0.99}).collect()}
    ranges = {c: found[c] for c in DRIFT}
    df = contract.drift_flags(t.features.where("partition_yyyymm >= '1998-01'"), ranges)
    return df.select("order_id", F.array_join("drifted", ",").alias("drifted"))


CONTRACT = ["order_approved_day_of_week", "order_approved_day_of_month", "order_approved_month", "is_weekend_approval",
            "is_december_peak", "order_item_count", "promised_lead_days", "approval_lag_hours"]


@query("validate_contract", """WITH b AS (SELECT order_id, customer_state,
      CASE WHEN order_id % 97 = 1 THEN 8 ELSE order_approved_day_of_week END AS wd,
      CASE WHEN order_id % 97 = 2 THEN 31 ELSE order_approved_day_of_month END AS dom,
      CASE WHEN order_id % 97 = 2 THEN 2 ELSE order_approved_month END AS mon,
      CASE WHEN order_id % 97 = 3 THEN 1 - is_weekend_approval ELSE is_weekend_approval END AS we,
      CASE WHEN order_id % 97 = 4 THEN 2 ELSE is_december_peak END AS dp,
      CASE WHEN order_id % 97 = 5 THEN 0 ELSE order_item_count END AS n,
      CASE WHEN order_id % 97 = 6 THEN 0.5::DOUBLE ELSE promised_lead_days END AS lead,
      CASE WHEN order_id % 97 = 7 THEN -1::DOUBLE WHEN order_id % 97 = 8 THEN 1e13::DOUBLE ELSE approval_lag_hours END AS lag,
      CASE WHEN order_id % 97 = 9 THEN 'MARS' ELSE customer_state END AS st FROM feat)
    SELECT rule, count(*) AS rows FROM (SELECT unnest([
      CASE WHEN abs(lag) > 1e12 THEN 'approval_lag_hours: magnitude' END,
      CASE WHEN wd NOT BETWEEN 1 AND 7 THEN 'order_approved_day_of_week: calendar bound' END,
      CASE WHEN dp NOT IN (0, 1) THEN 'is_december_peak: flag' END,
      CASE WHEN n < 1 THEN 'order_item_count: count' END,
      CASE WHEN lead <> floor(lead) THEN 'promised_lead_days: whole number' END,
      CASE WHEN lag < 0 THEN 'approval_lag_hours: negative' END,
      CASE WHEN dom > CASE WHEN mon = 2 THEN 29 WHEN mon IN (4, 6, 9, 11) THEN 30 ELSE 31 END THEN 'day not in month' END,
      CASE WHEN we <> (wd >= 6)::INTEGER THEN 'is_weekend_approval: inconsistent' END,
      CASE WHEN dp <> (mon = 12)::INTEGER THEN 'is_december_peak: inconsistent' END,
      CASE WHEN st NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST') THEN 'customer_state: category' END,
      CASE WHEN true THEN 'all rows' END]) AS rule FROM b) WHERE rule IS NOT NULL GROUP BY rule""")
def _(t):
    r = F.col("order_id") % 97
    bad = {"order_approved_day_of_week": F.when(r == 1, 8), "order_approved_day_of_month": F.when(r == 2, 31),
           "order_approved_month": F.when(r == 2, 2),
           "is_weekend_approval": F.when(r == 3, 1 - F.col("is_weekend_approval")),
           "is_december_peak": F.when(r == 4, 2), "order_item_count": F.when(r == 5, 0),
           "promised_lead_days": F.when(r == 6, 0.5),
           "approval_lag_hours": F.when(r == 7, -1.0).when(r == 8, 1e13)}
    df = t.features.select("order_id", F.when(r == 9, "MARS").otherwise(F.col("customer_state")).alias("customer_state"),
                           *[e.otherwise(F.col(c)).cast("double").alias(c) for c, e in bad.items()])
    states = [x[0] for x in t.raw("region").select("r_name").collect()]
    out = contract.validate(df, CONTRACT, {"customer_state": states})
    tags = F.concat(F.col("violations"), F.array(F.lit("all rows")))
    return out.select(F.explode(tags).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query("score_percentile", """SELECT order_id, round((SELECT count(*) FROM r_scores b WHERE b.p < a.p)
    / (SELECT count(p) FROM r_scores)::DOUBLE, 6) AS percentile FROM r_scores a WHERE p IS NOT NULL""")
def _(t):
    return contract.score_percentile(t.scores.where("p IS NOT NULL"), t.scores, "p").select("order_id", "percentile")


# ---- joins ----

@query("join_orders_customers", """SELECT order_id, o.customer_id, customer_zip, customer_city, customer_state
    FROM r_orders o LEFT JOIN r_customers USING (customer_id)""")
def _(t):
    return joins.orders_with_customers(t.orders, t.customers).select("order_id", "customer_id", "customer_zip", "customer_city", "customer_state")


@query("join_items_star", """SELECT order_id, item_seq, product_id, seller_id, round(price, 6) AS price, category, seller_state FROM f_star""")
def _(t):
    return t.star.select("order_id", "item_seq", "product_id", "seller_id", "price", "category", "seller_state")


@query("join_fanout", """SELECT (SELECT count(*) FROM r_orders) AS parent_rows, count(*) AS joined_rows,
    round(count(*) / (SELECT count(*) FROM r_orders)::DOUBLE, 6) AS inflation FROM r_orders LEFT JOIN r_items USING (order_id)""")
def _(t):
    return joins.join_fanout(t.orders, t.items, "order_id")


@query("join_outer_compare", """SELECT coalesce(b.s, v.s) AS state, buyers, sellers FROM
    (SELECT customer_city AS s, count(*) AS buyers FROM r_customers GROUP BY 1) b FULL JOIN
    (SELECT seller_city AS s, count(*) AS sellers FROM r_sellers GROUP BY 1) v ON b.s = v.s""")
def _(t):
    left = t.customers.groupBy(F.col("customer_city").alias("bk")).agg(F.count(F.lit(1)).alias("buyers"))
    right = t.sellers.groupBy(F.col("seller_city").alias("sk")).agg(F.count(F.lit(1)).alias("sellers"))
    return joins.outer_compare(left, right, "bk", "sk", "state")


@query("join_geo_lookup", """SELECT p.order_id, p.seller_id, round(zs.lat, 6) AS seller_lat, round(zc.lat, 6) AS customer_lat
    FROM (SELECT DISTINCT order_id, seller_id FROM r_items) p LEFT JOIN r_sellers s USING (seller_id) LEFT JOIN f_zip zs ON zs.zip = s.seller_zip
    LEFT JOIN r_orders o USING (order_id) LEFT JOIN r_customers c USING (customer_id) LEFT JOIN f_zip zc ON zc.zip = c.customer_zip""")
def _(t):
    zips = features.geo_median_by_zip(t.geolocation)
    def at(df, key, z, out):
        return df.join(zips.select(F.col("zip").alias(z), F.col("lat").alias(out)), z, "left").select(key, out)
    return (t.items.select("order_id", "seller_id").distinct()
            .join(at(t.sellers, "seller_id", "seller_zip", "seller_lat"), "seller_id", "left")
            .join(t.orders.select("order_id", "customer_id"), "order_id", "left")
            .join(at(t.customers, "customer_id", "customer_zip", "customer_lat"), "customer_id", "left")
            .select("order_id", "seller_id", "seller_lat", "customer_lat"))


@query("asof_seller_history", """SELECT order_id, seller_id, late::BIGINT AS late, prior_completed_orders, round(prior_late_rate, 6) AS prior_late_rate FROM sh""")
def _(t):
    return t.seller_history.select("order_id", "seller_id", "late", "prior_completed_orders", "prior_late_rate")


KNOWN = """known AS (SELECT order_id, (NOT ok)::BIGINT AS late, greatest(CASE WHEN ok THEN delivered_at::DATE ELSE estimated_at::DATE END + 1,
    approved_at::DATE + 1) AS known_day FROM (SELECT *, coalesce(delivered_at::DATE <= estimated_at::DATE, false) AS ok FROM r_orders
    WHERE approved_at IS NOT NULL AND NOT coalesce(delivered_at::DATE < approved_at::DATE, false)))"""


@query("asof_inclusive", f"""WITH {KNOWN}, daily AS (SELECT known_day, sum(count(*)) OVER (ORDER BY known_day) AS n,
    sum(sum(late)) OVER (ORDER BY known_day) AS late_n FROM known GROUP BY known_day)
    SELECT order_id, n::BIGINT AS prior_n, late_n::BIGINT AS prior_late_n FROM f_approved a ASOF LEFT JOIN daily d ON a.approved_day >= d.known_day""")
def _(t):
    run = asof.running_history(history.known_outcomes(t.orders), [], "known_day",
                               {"prior_n": F.lit(1).cast("bigint"), "prior_late_n": F.col("late")})
    asked = t.orders.where("approved_at IS NOT NULL").select("order_id", day("approved_at").alias("approved_day"))
    return asof.asof_state(asked, run, [], "approved_day", "known_day", ["prior_n", "prior_late_n"], strict=False) \
        .select("order_id", "prior_n", "prior_late_n")


MONTHS = "m AS (SELECT DISTINCT customer_id, date_trunc('month', approved_at)::DATE AS month FROM r_orders WHERE approved_at IS NOT NULL)"
REPEAT = f"""WITH {MONTHS} SELECT customer_id, month, (EXISTS (SELECT 1 FROM m b WHERE b.customer_id = a.customer_id
    AND b.month BETWEEN (a.month + INTERVAL 1 MONTH)::DATE AND (a.month + INTERVAL 3 MONTH)::DATE))::BIGINT AS repeat FROM m a"""


@query("range_join_repeat", REPEAT)
def _(t):
    return joins.ranged_repeat(joins.customer_months(t.orders, "customer_id", "approved_at"), "customer_id", "month")


@query("shift_union_join", REPEAT)
def _(t):
    return joins.shifted_repeat(joins.customer_months(t.orders, "customer_id", "approved_at"), "customer_id", "month")


@query("semi_in_list", "SELECT order_id, order_status FROM r_orders WHERE order_id IN (SELECT order_id FROM r_scores WHERE p >= 0.9)")
def _(t):
    return t.orders.join(t.scores.where("p >= 0.9").select("order_id"), "order_id", "left_semi").select("order_id", "order_status")


@query("anti_orphans", """SELECT 'items without order' AS check_name, count(*) AS rows, count(*) FILTER (WHERE order_id NOT IN (SELECT order_id FROM r_orders)) AS unmatched,
    round(100.0 * count(*) FILTER (WHERE order_id NOT IN (SELECT order_id FROM r_orders)) / count(*), 6)::DOUBLE AS unmatched_pct FROM r_items
    UNION ALL SELECT 'orders without items', count(*), count(*) FILTER (WHERE order_id NOT IN (SELECT order_id FROM r_items)),
    round(100.0 * count(*) FILTER (WHERE order_id NOT IN (SELECT order_id FROM r_items)) / count(*), 6)::DOUBLE FROM r_orders""")
def _(t):
    return audits.referential_integrity([("items without order", t.items, "order_id", t.orders, "order_id"),
                                         ("orders without items", t.orders, "order_id", t.items, "order_id")])


@query("validated_join", "SELECT order_id, order_status, round(p, 6) AS p FROM r_orders LEFT JOIN r_scores USING (order_id)")
def _(t):
    return joins.validated_join(t.orders, t.scores, "order_id").select("order_id", "order_status", "p")


@query("map_lookup", "SELECT order_id, (1 + (order_id * 7) % 5)::BIGINT AS order_score FROM r_orders WHERE order_id % 11 <> 0 UNION ALL SELECT order_id, NULL FROM r_orders WHERE order_id % 11 = 0")
def _(t):
    return joins.map_lookup(t.orders.select("order_id"), t.reviews.withColumnRenamed("score", "order_score"), "order_id", "order_score")


RUNS = ["1997-06-02", "1998-06-02", "1999-06-02"]


@query("cross_run_dates", " UNION ALL ".join(f"""SELECT DATE '{r}' AS run_date, {label(f"DATE '{r}'")} AS label, count(*) AS orders
    FROM r_orders GROUP BY 2""" for r in RUNS))
def _(t):
    import datetime as dt
    rows = joins.cross_params(t.orders.select("approved_at", "delivered_at", "estimated_at"),
                              [{"run_date": dt.date.fromisoformat(r)} for r in RUNS])
    return labels_as_of(rows, F.col("run_date")).groupBy("run_date", "label").agg(F.count(F.lit(1)).alias("orders"))


@query("interval_cohort_join", " UNION ALL ".join(f"""SELECT {b} AS buffer_days, count(*) AS orders FROM r_orders
    WHERE approved_at::DATE BETWEEN DATE '1998-06-01' - {b} - 29 AND DATE '1998-06-01' - {b}""" for b in (15, 30, 45)))
def _(t):
    import datetime as dt
    end = dt.date(1998, 6, 1)
    rows = [{"buffer_days": b, "start": end - dt.timedelta(days=b + 29), "end": end - dt.timedelta(days=b)} for b in (15, 30, 45)]
    return joins.interval_cohorts(t.orders.select("approved_at"), day("approved_at"), rows).groupBy("buffer_days") \
        .agg(F.count(F.lit(1)).alias("orders"))
