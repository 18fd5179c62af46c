"""Order-grain rollups, windows, bands, reshaping and descriptive cubes."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.bands import (LEAD_EDGES, LEAD_LABELS, WINDOW_EDGES, WINDOW_LABELS, cut_left_closed, cut_right_closed)
from ..functions.nulls import n_rows, ratio
from ..functions.times import day, month_start
from ..operators import audits, cubes, features, history, joins, ordering, reshape
from ..roles import PAYMENT_TYPES
from .catalog import FIRST_MONTH, ITEM_ORDER, LAST_MONTH, query
from .oracle import ITEM_ORDER as SQL_ORDER
from .oracle import TYPES


# ---- order-grain rollups ----

BASKET = ["order_item_count", "order_seller_count", "order_pdt_price_sum", "order_frieght_value_sum", "order_revenue_sum",
          "order_product_weight_g_sum", "order_product_category_count", "seller_zip_code_prefix_count", "seller_city_count",
          "seller_state_count"]


@query("order_item_rollup", """SELECT b.order_id, order_item_count, order_seller_count, round(order_pdt_price_sum, 4) AS order_pdt_price_sum,
    round(order_frieght_value_sum, 4) AS order_frieght_value_sum, round(order_revenue_sum, 4) AS order_revenue_sum,
    round(order_product_weight_g_sum, 4) AS order_product_weight_g_sum, order_product_category_count, seller_zip_code_prefix_count,
    seller_city_count, seller_state_count, states FROM f_basket b JOIN (SELECT order_id,
    string_agg(DISTINCT seller_state, '|' ORDER BY seller_state) AS states FROM f_star GROUP BY 1) s USING (order_id)""", digits=4)
def _(t):
    return features.order_item_rollup(t.items, t.products, t.sellers).select(
        "order_id", *BASKET, F.array_join("seller_states", "|").alias("states"))


@query("route_type", """SELECT a.order_id, f.route_type, CASE WHEN legs IS NULL THEN NULL WHEN same = legs THEN 'All same-state'
    WHEN same = 0 THEN 'All interstate' ELSE 'Mixed' END AS leg_route FROM f_approved a JOIN f_route f USING (order_id) LEFT JOIN
    (SELECT p.order_id, count(*) AS legs, count(*) FILTER (WHERE seller_state = customer_state) AS same FROM
    (SELECT DISTINCT order_id, seller_id, seller_state FROM f_star) p JOIN r_orders USING (order_id) JOIN r_customers USING (customer_id)
    GROUP BY 1) l ON l.order_id = a.order_id""")
def _(t):
    orders = t.orders.where("approved_at IS NOT NULL").join(t.customers, "customer_id", "left")
    legs = features.route_type_legs(orders, t.items, t.sellers).select("order_id", F.col("route_type").alias("leg_route"))
    return features.route_type(orders, t.items, t.sellers).join(legs, "order_id", "left")


@query("geo_median_by_zip", """SELECT zip, round(quantile_cont(lat, 0.5), 6) AS lat, round(quantile_cont(lng, 0.5), 6) AS lng FROM r_geo
    WHERE lat BETWEEN -34 AND 6 AND lng BETWEEN -74 AND -34 GROUP BY 1""")
def _(t):
    return features.geo_median_by_zip(t.geolocation, bounded=True)


@query("seller_distance_stats", """SELECT order_id, round(seller_dist_km_max, 6) AS seller_dist_km_max, round(seller_dist_km_min, 6) AS seller_dist_km_min,
    round(seller_dist_km_median, 6) AS seller_dist_km_median, round(seller_dist_km_mean, 6) AS seller_dist_km_mean, seller_dist_km_count FROM f_dist""")
def _(t):
    return features.seller_distance_stats(features.pair_distances(
        t.items, t.orders, t.customers, t.sellers, features.geo_median_by_zip(t.geolocation)))


@query("payment_pivot", "SELECT order_id, round(payment_value_sum, 4) AS payment_value_sum, " + ", ".join(
    f"round(payment_type_value_{x}, 4) AS payment_type_value_{x}, payment_type_count_{x}" for x in TYPES) + " FROM f_pay", digits=4)
def _(t):
    return features.payment_pivot(t.payments, PAYMENT_TYPES)


@query("payment_combination", """SELECT order_id, coalesce(payment_combination, 'no_payment') AS payment_combination FROM r_orders LEFT JOIN f_pay USING (order_id)""")
def _(t):
    return t.orders.select("order_id").join(features.payment_profile(t.payments), "order_id", "left").select(
        "order_id", F.coalesce("payment_combination", F.lit("no_payment")).alias("payment_combination"))


@query("payment_installments_max", "SELECT order_id, payment_installments_max::BIGINT AS payment_installments_max FROM f_pay")
def _(t):
    return features.payment_profile(t.payments).select("order_id", "payment_installments_max")


@query("volume_photos", """SELECT order_id, sum(volume)::DOUBLE AS order_product_volume_cm3_sum, round(avg(photos), 6) AS order_product_photos_mean
    FROM f_star GROUP BY 1""")
def _(t):
    return features.volume_photos(t.items, t.products)


@query("primary_item", f"""SELECT f.*, p.primary_payment_type FROM f_first f JOIN (SELECT order_id,
    arg_min(payment_type, (payment_seq, payment_type)) AS primary_payment_type FROM r_payments GROUP BY 1) p USING (order_id)""")
def _(t):
    return features.primary_item(t.items, t.products, t.sellers, ITEM_ORDER).join(features.primary_payment(t.payments), "order_id")


@query("ordered_join_agg", "SELECT order_id, string_agg(DISTINCT seller_state, ', ' ORDER BY seller_state) AS joined FROM f_star GROUP BY 1")
def _(t):
    return features.ordered_join(t.items.join(t.sellers, "seller_id", "left"), "order_id", "seller_state")


@query("review_rollup", """SELECT order_id, round(avg(score), 6) AS review_score, min(score)::BIGINT AS lowest_score,
    arg_max(score, (answered_at, review_id))::BIGINT AS latest_score, bool_or(comment IS NOT NULL) AS has_review_comment FROM r_reviews GROUP BY 1""")
def _(t):
    return features.review_rollup(t.reviews)


FEATS = [c for c in features.numeric_cols(PAYMENT_TYPES)]


@query("feature_table", "SELECT order_id, partition_yyyymm, customer_state, route_type, payment_combination, " + ", ".join(
    f"round({c}::DOUBLE, 4) AS {c}" for c in FEATS) + " FROM feat", digits=4)
def _(t):
    return t.features.select("order_id", "partition_yyyymm", "customer_state", "route_type", "payment_combination",
                             *[F.col(c).cast("double").alias(c) for c in FEATS])


@query("order_outcome_table", """SELECT order_id, approved_day, approved_month, purchase_weekday, order_status, customer_state, route_type,
    item_count, seller_count, round(order_value, 4) AS order_value, payment_combination, primary_category, primary_seller_state,
    round(review_score, 4) AS review_score, has_review_comment, late::BIGINT AS late, label_status, days_from_promise, review_group FROM ot""", digits=4)
def _(t):
    return t.order_table.select("order_id", "approved_day", "approved_month", "purchase_weekday", "order_status", "customer_state",
                                "route_type", "item_count", "seller_count", "order_value", "payment_combination", "primary_category",
                                "primary_seller_state", "review_score", "has_review_comment", "late", "label_status",
                                "days_from_promise", "review_group")


# ---- windows ----

@query("trailing_7d_load", "SELECT d AS approved_day, c AS approved, orders_approved_prev_7d FROM f_daily JOIN f_load USING (d)")
def _(t):
    return features.trailing_load(t.orders)


@query("seller_running_history", """SELECT seller_id, delivered_at::DATE AS delivered_day, prior_completed_orders::BIGINT AS prior_completed_orders,
    prior_late_orders::BIGINT AS prior_late_orders, prior_deviation_sum::BIGINT AS prior_deviation_sum,
    round(prior_late_orders / prior_completed_orders::DOUBLE, 6) AS prior_late_rate FROM s_events""")
def _(t):
    return history.seller_running_history(t.orders, t.items).select(
        "seller_id", day("delivered_at").alias("delivered_day"), "prior_completed_orders", "prior_late_orders", "prior_deviation_sum",
        "prior_late_rate")


def _smoothed(entity, prefix):
    from .tables_and_joins import KNOWN
    return f"""WITH {KNOWN}, gd AS (SELECT known_day, sum(count(*)) OVER (ORDER BY known_day) AS n, sum(sum(late)) OVER (ORDER BY known_day) AS ln
    FROM known GROUP BY known_day), q AS (SELECT order_id, approved_at::DATE AS approved_day FROM r_orders WHERE approved_at IS NOT NULL),
    g AS (SELECT order_id, approved_day, coalesce(ln / n::DOUBLE, 0.5::DOUBLE) AS gr FROM q ASOF LEFT JOIN gd ON q.approved_day >= gd.known_day),
    mem AS (SELECT DISTINCT order_id, {entity} AS e FROM r_items), ev AS (SELECT e, known_day,
    sum(count(*)) OVER (PARTITION BY e ORDER BY known_day) AS n, sum(sum(late)) OVER (PARTITION BY e ORDER BY known_day) AS ln
    FROM mem JOIN known USING (order_id) GROUP BY e, known_day), mq AS (SELECT * FROM mem JOIN g USING (order_id)),
    h AS (SELECT mq.order_id, (coalesce(ln, 0) + 10 * gr) / (coalesce(n, 0) + 10) AS r, (coalesce(n, 0) = 0)::INTEGER AS u
    FROM mq ASOF LEFT JOIN ev ON mq.e = ev.e AND mq.approved_day >= ev.known_day)
    SELECT g.order_id, round(coalesce(r, gr), 9) AS {prefix}_late_rate_mean, round(coalesce(u, 1), 9) AS {prefix}_no_history_share
    FROM g LEFT JOIN (SELECT order_id, avg(r) AS r, avg(u) AS u FROM h GROUP BY 1) x ON x.order_id = g.order_id"""


@query("entity_history_smoothed", _smoothed("seller_id", "seller"), digits=9)
def _(t):
    return history.smoothed_entity_history(t.orders, t.items, "seller_id", "seller")


@query("entity_history_smoothed_product", _smoothed("product_id", "product"), digits=9)
def _(t):
    return history.smoothed_entity_history(t.orders, t.items, "product_id", "product")


@query("order_history_rollup", """SELECT order_id, min(prior_completed_orders)::BIGINT AS minimum_seller_history, round(max(prior_late_rate), 6) AS maximum_prior_late_rate,
    round(max(prior_mean_deviation), 6) AS maximum_prior_mean_deviation, count(*) FILTER (WHERE prior_completed_orders = 0) AS new_seller_count
    FROM sh GROUP BY 1""")
def _(t):
    return history.order_history_rollup(t.seller_history)


MONTHLY = "SELECT approved_month, count(*) AS orders, sum(round(payment_value * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS revenue FROM ot GROUP BY 1"


@query("mom_yoy_change", f"""SELECT approved_month, round(revenue, 4) AS revenue, round(revenue / lag(revenue) OVER w - 1, 4) AS mom,
    round(revenue / lag(revenue, 12) OVER w - 1, 4) AS yoy FROM ({MONTHLY}) WINDOW w AS (ORDER BY approved_month)""", digits=4)
def _(t):
    return cubes.mom_yoy(cubes.monthly_sales(t.order_table), "revenue")


@query("share_within_group", """SELECT customer_state, route_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY customer_state)::DOUBLE, 6) AS share
    FROM ot WHERE route_type IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return cubes.share_within_group(t.order_table, "customer_state", "route_type")


# ---- sorts, sets, reshape ----

@query("stable_multi_sort", """SELECT order_id, round(p, 6) AS p, row_number() OVER (ORDER BY p DESC, order_id) AS position FROM r_scores WHERE p IS NOT NULL""")
def _(t):
    return ordering.global_rank(t.scores.where("p IS NOT NULL"), [F.desc("p"), F.asc("order_id")]) \
        .select("order_id", "p", F.col("rank").alias("position"))


@query("dedupe_first", f"""SELECT order_id, seller_id, product_id FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY
    item_seq, product_id, seller_id, price, shipping_limit) AS rn FROM r_items) WHERE rn = 1""")
def _(t):
    return joins.dedupe_first(t.items.drop("freight_value"), ["order_id"], ITEM_ORDER).select("order_id", "seller_id", "product_id")


@query("distinct_rows", "SELECT DISTINCT order_id, seller_id FROM r_items")
def _(t):
    return t.items.select("order_id", "seller_id").distinct()


@query("duplicate_audit", """SELECT (SELECT count(*) FROM r_items) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r_items)) AS duplicate_rows,
    (SELECT sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM r_items GROUP BY order_id, item_seq)) AS repeated_keys""")
def _(t):
    return audits.duplicate_audit(t.items, ["order_id", "item_seq"])


@query("union_all", """SELECT 'weekday' AS tag, count(*) AS orders FROM f_approved WHERE isodow(approved_day) < 6 UNION ALL
    SELECT 'weekend', count(*) FROM f_approved WHERE isodow(approved_day) >= 6""")
def _(t):
    flagged = features.calendar_flags(t.orders.where("approved_at IS NOT NULL"))
    part = lambda tag, v: flagged.where(F.col("is_weekend_approval") == v).agg(n_rows("orders")).select(F.lit(tag).alias("tag"), "orders")
    return audits.union_all([part("weekday", 0), part("weekend", 1)])


@query("concat_columns", """SELECT coalesce(a.customer_state, b.customer_state) AS customer_state, a.n AS orders_1997, b.n AS orders_1998 FROM
    (SELECT customer_state, count(*) AS n FROM ot WHERE year(approved_day) = 1997 GROUP BY 1) a FULL JOIN
    (SELECT customer_state, count(*) AS n FROM ot WHERE year(approved_day) = 1998 GROUP BY 1) b USING (customer_state)""")
def _(t):
    year = lambda y: t.order_table.where(F.year("approved_day") == y).groupBy("customer_state").agg(n_rows("orders"))
    return reshape.concat_columns({"1997": year(1997), "1998": year(1998)}, "customer_state")


@query("set_difference", "SELECT order_id FROM r_orders EXCEPT SELECT order_id FROM r_items")
def _(t):
    return reshape.set_difference(t.orders.select("order_id"), t.items.select("order_id"))


@query("set_intersection", "SELECT customer_city AS place FROM r_customers INTERSECT SELECT seller_city FROM r_sellers")
def _(t):
    return reshape.set_intersection(t.customers.select(F.col("customer_city").alias("place")), t.sellers.select(F.col("seller_city").alias("place")))


@query("pivot_wide", """SELECT customer_state, count(*) FILTER (WHERE route_type = '1. All interstate') AS "1. All interstate",
    count(*) FILTER (WHERE route_type = '2. All same-state') AS "2. All same-state", count(*) FILTER (WHERE route_type = '3. Mixed') AS "3. Mixed" FROM ot GROUP BY 1""")
def _(t):
    return reshape.pivot_wide(t.order_table, ["customer_state"], "route_type",
                              ["1. All interstate", "2. All same-state", "3. Mixed"], n_rows()).na.fill(0)


@query("unpivot_long", """SELECT customer_state, measure, value FROM (SELECT customer_state, round(sum(order_value), 4) AS order_value,
    round(sum(freight_value), 4) AS freight_value FROM ot GROUP BY 1) UNPIVOT (value FOR measure IN (order_value, freight_value))""", digits=4)
def _(t):
    wide = t.order_table.groupBy("customer_state").agg(F.sum("order_value").alias("order_value"), F.sum("freight_value").alias("freight_value"))
    return wide.unpivot("customer_state", ["order_value", "freight_value"], "measure", "value")


@query("calendar_spine", """WITH span AS (SELECT unnest(generate_series((SELECT min(d) FROM f_daily), (SELECT max(d) FROM f_daily), INTERVAL 1 DAY))::DATE AS day)
    SELECT day, coalesce(c, 0)::BIGINT AS orders FROM span LEFT JOIN f_daily ON d = day""")
def _(t):
    daily = t.orders.where("approved_at IS NOT NULL").groupBy(day("approved_at").alias("day")).agg(n_rows("orders"))
    return reshape.calendar_spine(daily, "day", ["orders"])


@query("sample_one_per_day")
def _(t):
    return reshape.sample_one_per_day(t.scored, "approval_day", "order_id", 30).select("approval_day", "order_id")


@query("subsample_rows")
def _(t):
    return reshape.subsample(t.scored, "order_id", 5000).select("order_id", "p")


# ---- bands ----

@query("cut_right_closed", """SELECT CASE WHEN promised_lead_days <= 14 THEN '<= 14 days' WHEN promised_lead_days <= 21 THEN '15-21 days'
    WHEN promised_lead_days <= 28 THEN '22-28 days' ELSE '> 28 days' END AS band, count(*) AS orders FROM ot GROUP BY 1""")
def _(t):
    return t.order_table.groupBy(cut_right_closed("promised_lead_days", LEAD_EDGES, LEAD_LABELS).alias("band")).agg(n_rows("orders"))


W_BAND = """CASE WHEN promised_lead_days < 11 THEN '0–10 days' WHEN promised_lead_days < 21 THEN '11–20'
    WHEN promised_lead_days < 31 THEN '21–30' ELSE '31+' END"""


@query("cut_left_closed", f"SELECT {W_BAND} AS band, count(*) AS orders FROM ot GROUP BY 1")
def _(t):
    return t.order_table.groupBy(cut_left_closed("promised_lead_days", WINDOW_EDGES, WINDOW_LABELS).alias("band")).agg(n_rows("orders"))


def _qcut(c, n):
    q = ", ".join(str(i / n) for i in range(1, n))
    cases = " ".join(f"WHEN {c} <= q[{i}] THEN {i - 1}" for i in range(1, n))
    return f"(SELECT quantile_cont({c}, [{q}]) AS q FROM src WHERE {c} IS NOT NULL)", f"CASE {cases} ELSE {n - 1} END"


_E, _C = _qcut("payment_value", 5)


@query("qcut_bands", f"""WITH src AS (SELECT payment_value FROM ot WHERE payment_value IS NOT NULL) SELECT {_C} AS band, count(*) AS orders,
    round(min(payment_value), 4) AS low, round(max(payment_value), 4) AS high FROM src, {_E} GROUP BY 1""", digits=4)
def _(t):
    df = t.order_table.where("payment_value IS NOT NULL")
    edges = ordering.quantile_edges(df, "payment_value", 5)
    return df.groupBy(ordering.qcut_code("payment_value", edges).alias("band")).agg(
        n_rows("orders"), F.min("payment_value").alias("low"), F.max("payment_value").alias("high"))


@query("trimmed_histogram", """WITH q AS (SELECT quantile_cont(days_from_promise, 0.01) AS lo, quantile_cont(days_from_promise, 0.99) AS hi FROM ot)
    SELECT ceil(days_from_promise)::BIGINT AS days, count(*) AS orders, CASE WHEN ceil(days_from_promise) > 0 THEN 'Late' ELSE 'On time or early' END AS side
    FROM ot, q WHERE days_from_promise BETWEEN lo AND hi GROUP BY 1, 3""")
def _(t):
    return cubes.trimmed_histogram(t.order_table, "days_from_promise")


# ---- cubes ----

@query("late_rate_by", "SELECT customer_state, route_type, count(*) AS orders, round(avg(late), 6) AS late_rate FROM od WHERE late IS NOT NULL AND route_type IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20")
def _(t):
    return cubes.late_rate_by(t.delivered, "customer_state", "route_type", min_orders=20)


@query("monthly_late_rate", """WITH m AS (SELECT approved_month, count(*) AS delivered, avg(late) AS late_rate FROM od WHERE late IS NOT NULL GROUP BY 1)
    SELECT strftime(approved_month, '%Y-%m') AS month, delivered, round(late_rate, 6) AS late_rate FROM m UNION ALL
    SELECT 'mean', count(*), round(avg(late_rate), 6) FROM m UNION ALL SELECT 'median', count(*), round(quantile_cont(late_rate, 0.5), 6) FROM m""")
def _(t):
    m = cubes.monthly_late_rate(t.delivered)
    avg = cubes.monthly_rate_average(m)
    return audits.union_all([
        m.select(F.date_format("approved_month", "yyyy-MM").alias("month"), "delivered", "late_rate"),
        avg.select(F.lit("mean").alias("month"), F.col("months").alias("delivered"), F.col("mean_monthly_rate").alias("late_rate")),
        avg.select(F.lit("median").alias("month"), F.col("months").alias("delivered"), F.col("median_monthly_rate").alias("late_rate"))])


@query("top_category_trend", """WITH x AS (SELECT date_trunc('month', purchase_ts)::DATE AS month, category FROM f_star JOIN r_orders USING (order_id) WHERE category IS NOT NULL),
    top AS (SELECT category FROM x GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 3) SELECT month, category, count(*) AS items FROM x WHERE category IN (SELECT category FROM top) GROUP BY 1, 2""")
def _(t):
    items = t.items.select("order_id", "product_id").join(t.products.select("product_id", "category"), "product_id", "left") \
        .join(t.orders.select("order_id", month_start("purchase_ts").alias("month")), "order_id").where("category IS NOT NULL")
    return cubes.top_category_trend(items, cubes.top_categories(items, 3))


@query("route_share_by_state", """WITH top AS (SELECT customer_state FROM ot WHERE route_type IS NOT NULL AND customer_state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
    c AS (SELECT CASE WHEN customer_state IN (SELECT customer_state FROM top) THEN customer_state ELSE 'Others' END AS state, route_type, count(*) AS n
    FROM ot WHERE route_type IS NOT NULL GROUP BY 1, 2), s AS (SELECT state, route_type, 100.0 * n / sum(n) OVER (PARTITION BY state)::DOUBLE AS pct FROM c)
    SELECT state, round(max(pct) FILTER (WHERE route_type = '1. All interstate'), 6) AS "1. All interstate",
    round(max(pct) FILTER (WHERE route_type = '2. All same-state'), 6) AS "2. All same-state", round(max(pct) FILTER (WHERE route_type = '3. Mixed'), 6) AS "3. Mixed" FROM s GROUP BY 1""")
def _(t):
    top = cubes.most_common(t.order_table.where("route_type IS NOT NULL"), "customer_state", 3)
    return cubes.route_share_by_state(t.order_table, top, ["1. All interstate", "2. All same-state", "3. Mixed"])


@query("review_score_distribution", "SELECT round(review_score)::BIGINT AS score, count(*) AS orders FROM ot WHERE review_score IS NOT NULL GROUP BY 1")
def _(t):
    return cubes.review_score_distribution(t.order_table)


CENTS = "sum(round(payment_value * 100)::BIGINT)::BIGINT / 100.0::DOUBLE"


@query("monthly_sales", f"""SELECT approved_month, orders, round(revenue, 6) AS revenue, round(revenue / nullif(paid, 0), 6) AS mean_paid_order, round(revenue / orders, 6) AS average_order
    FROM (SELECT approved_month, count(*) AS orders, count(payment_value) AS paid, {CENTS} AS revenue FROM ot GROUP BY 1)""")
def _(t):
    return cubes.monthly_sales(t.order_table)


@query("status_share", "SELECT order_status, count(*) AS orders, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM r_orders GROUP BY 1")
def _(t):
    return cubes.status_share(t.orders)


@query("category_summary", """SELECT category, count(DISTINCT order_id) AS orders, count(*) AS quantity, round(sum(price), 4) AS value, round(sum(price) / count(*), 4) AS value_per_unit
    FROM f_star WHERE category IS NOT NULL GROUP BY 1""", digits=4)
def _(t):
    return cubes.category_summary(t.star)


@query("state_distribution", " UNION ALL ".join(f"""SELECT '{p}' AS side, {p}_state AS state, count(DISTINCT {p}_id) AS members, count(DISTINCT {p}_city) AS cities,
    round(100.0 * count(DISTINCT {p}_id) / sum(count(DISTINCT {p}_id)) OVER ()::DOUBLE, 6) AS share_pct,
    round(count(DISTINCT {p}_id) / count(DISTINCT {p}_city)::DOUBLE, 6) AS members_per_city FROM r_{p}s GROUP BY {p}_state""" for p in ("customer", "seller")))
def _(t):
    return audits.union_all([cubes.state_distribution(df, p).select(F.lit(p).alias("side"), "*")
                             for df, p in ((t.customers, "customer"), (t.sellers, "seller"))])


@query("item_share_by_state", """WITH x AS (SELECT customer_state, seller_state FROM f_star JOIN r_orders USING (order_id) JOIN r_customers USING (customer_id)),
    b AS (SELECT customer_state AS s, 100.0 * count(*) / sum(count(*)) OVER ()::DOUBLE AS buyer_share FROM x GROUP BY 1),
    v AS (SELECT seller_state AS s, 100.0 * count(*) / sum(count(*)) OVER ()::DOUBLE AS seller_share FROM x GROUP BY 1)
    SELECT s AS state, round(buyer_share, 6) AS buyer_share, round(seller_share, 6) AS seller_share, round(seller_share / buyer_share, 6) AS seller_to_buyer
    FROM b FULL JOIN v USING (s)""")
def _(t):
    return cubes.item_share_by_state(t.items.select("order_id", "seller_id").join(t.sellers, "seller_id", "left")
                                     .join(joins.orders_with_customers(t.orders, t.customers), "order_id"))


HOURS = range(24)


@query("weekday_hour_heatmap", "SELECT isodow(approved_at)::BIGINT AS purchase_weekday, " + ", ".join(
    f'count(DISTINCT order_id) FILTER (WHERE hour(approved_at) = {h}) AS "{h}"' for h in HOURS) + " FROM f_approved GROUP BY 1")
def _(t):
    from ..functions.scalars import iso_weekday
    df = t.orders.where("approved_at IS NOT NULL").select("order_id", iso_weekday("approved_at").alias("purchase_weekday"), F.hour("approved_at").alias("purchase_hour"))
    return cubes.weekday_hour_grid(df, list(HOURS))


@query("route_late_summary", """SELECT route_type, count(*) AS delivered, round(avg(late), 6) AS late_rate,
    round(quantile_cont(days_from_promise, 0.5) FILTER (WHERE late = 1), 6) AS median_days_late FROM od WHERE late IS NOT NULL AND route_type IS NOT NULL GROUP BY 1""")
def _(t):
    return cubes.route_late_summary(t.delivered)


@query("total_row_rollup", """SELECT CASE WHEN grouping(route_type) = 1 THEN 'Total' ELSE route_type END AS "group", count(*) AS orders, sum(late)::BIGINT AS late_orders,
    round(avg(late), 6) AS late_rate FROM od WHERE late IS NOT NULL AND route_type IS NOT NULL GROUP BY ROLLUP (route_type)""")
def _(t):
    return cubes.total_row_rollup(t.delivered, "route_type")


@query("route_pair_late", """SELECT primary_seller_state || ' → ' || customer_state AS route, count(*) AS orders, round(avg(late), 6) AS late_rate FROM od
    WHERE late IS NOT NULL AND primary_seller_state IS NOT NULL GROUP BY 1 HAVING count(*) >= 20 ORDER BY orders DESC, route LIMIT 10""")
def _(t):
    return cubes.route_pair_late(t.delivered, 20, 10)


@query("stage_share", """WITH b AS (SELECT CASE late WHEN 1 THEN 'Late' ELSE 'On time' END AS outcome, approval_to_carrier_days AS a, approval_to_customer_days - approval_to_carrier_days AS c
    FROM od WHERE late IS NOT NULL AND approval_to_carrier_days IS NOT NULL AND approval_to_customer_days IS NOT NULL), w AS (SELECT outcome, avg(a / (a + c)) AS to_carrier,
    avg(c / (a + c)) AS to_customer FROM b WHERE a >= 0 AND c >= 0 AND a + c > 0 GROUP BY 1), m AS (SELECT outcome, quantile_cont(a, 0.5) AS to_carrier, quantile_cont(c, 0.5) AS to_customer FROM b GROUP BY 1)
    SELECT 'mean share' AS view, outcome, 'to_carrier' AS stage, round(to_carrier, 6) AS value FROM w UNION ALL SELECT 'mean share', outcome, 'to_customer', round(to_customer, 6) FROM w
    UNION ALL SELECT 'median days', outcome, 'to_carrier', round(to_carrier, 6) FROM m UNION ALL SELECT 'median days', outcome, 'to_customer', round(to_customer, 6) FROM m""")
def _(t):
    a = cubes.stage_share(t.delivered, "mean").select(F.lit("mean share").alias("view"), "outcome", "stage", F.col("share").alias("value"))
    b = cubes.stage_share(t.delivered, "median").select(F.lit("median days").alias("view"), "outcome", "stage", F.col("days").alias("value"))
    return a.unionByName(b)


def _bands(expr):
    return f"""SELECT band, count(*) AS orders, round(avg(late), 6) AS late_rate, round(quantile_cont(days_from_promise, 0.5), 6) AS median_deviation,
    round(quantile_cont(days_from_promise, 0.5) FILTER (WHERE late = 1), 6) AS median_days_late, round(100.0 * count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share_pct
    FROM (SELECT *, {expr} AS band FROM od WHERE late IS NOT NULL) WHERE band IS NOT NULL GROUP BY band"""


@query("distance_band_summary", _bands("""CASE WHEN seller_dist_km_mean < 100 THEN '< 100 km' WHEN seller_dist_km_mean < 300 THEN '100–299' WHEN seller_dist_km_mean < 600 THEN '300–599'
    WHEN seller_dist_km_mean < 1000 THEN '600–999' WHEN seller_dist_km_mean < 2000 THEN '1,000–1,999' WHEN seller_dist_km_mean < 99999 THEN '2,000+' END"""))
def _(t):
    return cubes.band_summary(t.delivered, cubes.distance_band())


@query("window_band_summary", _bands(W_BAND))
def _(t):
    return cubes.band_summary(t.delivered, cubes.window_band())


_E2, _C2 = _qcut("freight_value", 5)


@query("attribute_quintile_summary", f"""WITH src AS (SELECT freight_value, late FROM od WHERE late IS NOT NULL AND freight_value IS NOT NULL)
    SELECT {_C2} + 1 AS band, count(*) AS orders, round(avg(late), 4) AS late_rate, round(min(freight_value), 4) AS low, round(max(freight_value), 4) AS high FROM src, {_E2} GROUP BY 1""", digits=4)
def _(t):
    return cubes.quintile_summary(t.delivered, "freight_value")


@query("review_group_late", """SELECT coalesce(review_group, 'No review') AS review_group, count(*) AS orders, sum(late)::BIGINT AS late, round(100.0 * sum(late) / count(*)::DOUBLE, 6) AS late_rate_pct
    FROM od WHERE late IS NOT NULL GROUP BY 1""")
def _(t):
    return cubes.review_group_late(t.delivered, with_missing=True)


@query("review_kpis", """SELECT count(review_score) AS reviewed, round(avg((review_score <= 2)::INTEGER), 6) AS low_share,
    round(avg(has_review_comment::INTEGER) FILTER (WHERE review_score IS NOT NULL), 6) AS comment_share,
    round(avg((late = 0)::INTEGER) FILTER (WHERE review_score <= 2 AND late IS NOT NULL), 6) AS on_time_among_low FROM od""")
def _(t):
    return cubes.review_kpis(t.delivered)


@query("kpi_cards", """SELECT count(*) AS orders, count(DISTINCT customer_id) AS customers, round(sum(order_value), 3) AS value, round(avg(late), 3) AS late_rate, round(avg(review_score), 3) AS mean_score FROM od""", digits=3)
def _(t):
    return cubes.kpi_cards(t.delivered)


@query("repeat_purchase_monthly", """WITH m AS (SELECT DISTINCT customer_id, date_trunc('month', approved_at)::DATE AS month FROM r_orders WHERE approved_at IS NOT NULL),
    f AS (SELECT customer_id, month, (EXISTS (SELECT 1 FROM m b WHERE b.customer_id = a.customer_id AND b.month BETWEEN (a.month + INTERVAL 1 MONTH)::DATE AND (a.month + INTERVAL 3 MONTH)::DATE))::INTEGER AS r FROM m a)
    SELECT month, count(*) AS customers, sum(r)::BIGINT AS repeat_customers, round(sum(r) / count(*)::DOUBLE, 6) AS repeat_rate, month <= DATE '2001-03-01' AS complete_window FROM f GROUP BY 1""")
def _(t):
    flags = joins.shifted_repeat(joins.customer_months(t.orders, "customer_id", "approved_at"), "customer_id", "month")
    return joins.repeat_monthly(flags, "customer_id", "month", LAST_MONTH)


@query("seller_performance", """SELECT seller_id, count(*) AS orders, round(avg(late), 6) AS late_rate, round(quantile_cont(deviation_days, 0.5), 6) AS median_deviation FROM sh GROUP BY 1 HAVING count(*) >= 30""")
def _(t):
    return cubes.seller_performance(t.seller_history, 30)


@query("seller_experience_bands", """SELECT 'experience' AS view, CASE WHEN prior_completed_orders < 1 THEN 'New seller' WHEN prior_completed_orders < 10 THEN '1–9' WHEN prior_completed_orders < 50 THEN '10–49'
    WHEN prior_completed_orders < 200 THEN '50–199' ELSE '200+' END AS band, count(*) AS orders, round(avg(late), 6) AS late_rate FROM sh GROUP BY 2 UNION ALL
    SELECT 'track record', CASE WHEN prior_late_rate < 0.05 THEN '< 5%' WHEN prior_late_rate < 0.10 THEN '5–10%' WHEN prior_late_rate < 0.20 THEN '10–20%' WHEN prior_late_rate < 1.01 THEN '20%+' ELSE 'No history' END,
    count(*), round(avg(late), 6) FROM sh GROUP BY 2""")
def _(t):
    return cubes.seller_bands(t.seller_history)


@query("cross_state_category_topk", """WITH x AS (SELECT customer_state, customer_id, category FROM f_star JOIN r_orders USING (order_id) JOIN r_customers USING (customer_id) WHERE category IS NOT NULL),
    c AS (SELECT customer_state, category, count(*) AS quantity, row_number() OVER (PARTITION BY customer_state ORDER BY count(*) DESC, category) AS place FROM x GROUP BY 1, 2)
    SELECT c.*, buyers, round(quantity / buyers::DOUBLE, 6) AS per_buyer FROM c JOIN (SELECT customer_state, count(DISTINCT customer_id) AS buyers FROM x GROUP BY 1) USING (customer_state) WHERE place <= 5""")
def _(t):
    star = t.items.select("order_id", "product_id").join(t.products.select("product_id", "category"), "product_id", "left") \
        .join(joins.orders_with_customers(t.orders, t.customers).select("order_id", "customer_id", "customer_state"), "order_id")
    return cubes.cross_state_topk(star, 5)


CORR = ["order_value", "freight_value", "promised_lead_days", "days_from_promise", "review_score"]


@query("pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS left_col, '{b}' AS right_col, round(corr({a}, {b}), 6) AS pearson FROM ot"
                                            for i, a in enumerate(CORR) for b in CORR[i + 1:]))
def _(t):
    return cubes.pearson_matrix(t.order_table, CORR)


DESC = ["days_from_promise", "order_value"]


@query("describe_percentiles", " UNION ALL ".join(f"""SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(min({c}), 4) AS min, round(max({c}), 4) AS max, """
    + ", ".join(f"round(quantile_cont({c}, {p / 100}), 4) AS p{p}" for p in (5, 25, 50, 75, 95, 99)) + " FROM ot" for c in DESC), digits=4)
def _(t):
    return cubes.describe(t.order_table, DESC)


SKEW = ["payment_value", "freight_value", "days_from_promise", "item_count"]


@query("skewness_table", " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(min({c})::DOUBLE, 4) AS min, round(skewness({c}), 4) AS skew_raw,
    CASE WHEN min({c}) >= 0 THEN round(skewness(CASE WHEN {c} >= 0 THEN ln(1 + {c}) END), 4) END AS skew_log1p, min({c}) >= 0 AS non_negative, min({c}) >= 0 AND abs(skewness({c})) > 1 AS log1p_recommended FROM ot""" for c in SKEW), digits=4)
def _(t):
    return cubes.skewness_table(t.order_table, SKEW)


RANGES = ["promised_lead_days", "order_item_count", "payment_value_sum", "is_december_peak", "freight_to_price_ratio"]
KINDS = ["integer", "integer", "continuous", "binary", "continuous"]


@query("numeric_ranges", " UNION ALL ".join(f"""SELECT '{c}' AS variable, count({c}) AS n, round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}::DOUBLE, 0.01), 4) AS p01,
    round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.99), 4) AS p99, round(max({c})::DOUBLE, 4) AS max, '{k}' AS kind FROM feat""" for c, k in zip(RANGES, KINDS)), digits=4)
def _(t):
    return cubes.numeric_ranges(t.features, RANGES)


@query("category_levels_and_mode", " UNION ALL ".join(f"""SELECT '{c}' AS feature, string_agg({c}, '|' ORDER BY {c}) AS levels, arg_min({c}, (-n, {c})) AS mode FROM (SELECT {c}, count(*) AS n FROM ot WHERE {c} IS NOT NULL GROUP BY 1)"""
                                                      for c in ("customer_state", "route_type", "order_status")))
def _(t):
    return cubes.category_levels(t.order_table, ["customer_state", "route_type", "order_status"])


@query("score_histogram", """WITH r AS (SELECT min(p) AS lo, (max(p) - min(p)) / 30.0::DOUBLE AS w, max(p) AS hi FROM r_scores) SELECT least(floor((p - lo) / w), 29)::BIGINT AS bin, count(*) AS orders,
    round(any_value(lo) + least(floor((p - lo) / w), 29) * any_value(w), 6) AS lower FROM r_scores, r WHERE p IS NOT NULL GROUP BY least(floor((p - lo) / w), 29)""")
def _(t):
    return cubes.score_histogram(t.scores, "p")


@query("residuals_by_segment", """SELECT customer_state, count(*) AS n, round(avg(target), 6) AS mean_actual, round(avg(days), 6) AS mean_predicted, round(avg(days - target), 6) AS bias, round(avg(abs(days - target)), 6) AS mae
    FROM scored WHERE target IS NOT NULL GROUP BY 1""")
def _(t):
    return cubes.residuals_by_segment(t.scored, "customer_state", "target", "days")


@query("top_n_by_metric", """SELECT category, count(*) AS quantity, round(sum(price), 4) AS value FROM f_star WHERE category IS NOT NULL GROUP BY 1 ORDER BY sum(price) DESC, category LIMIT 4""", digits=4)
def _(t):
    return cubes.top_n(cubes.category_summary(t.star), "value", 4, "category").select("category", "quantity", "value")
