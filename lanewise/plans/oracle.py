"""The same role views and derived tables as plain SQL, for cross-checking results."""
from __future__ import annotations

import re

_K = "o_orderkey"
_LEAD = (f"CASE WHEN {_K} % 2500 = 17 THEN -1 WHEN {_K} % 50 = 0 THEN 41 + {_K} % 40 "
         f"ELSE 1 + (37 * {_K} + 11 * o_custkey) % 30 END")
_GONE = f"({_K} % 90 = 13 OR {_K} % 40 = 7)"
ITEM_ORDER = "(item_seq, product_id, seller_id, price, shipping_limit)"
TYPES = ["AF", "AO", "NF", "NO", "RF", "RO"]


def valid(run):
    return (f"(approved_at IS NOT NULL AND approved_at::DATE < {run} AND estimated_at IS NOT NULL "
            f"AND NOT coalesce(delivered_at::DATE < approved_at::DATE, false))")


def arrived(run):
    return f"coalesce(delivered_at::DATE < {run}, false)"


def status(run):
    return (f"CASE WHEN NOT {valid(run)} THEN 'invalid_or_missing_dates' "
            f"WHEN {arrived(run)} AND delivered_at::DATE <= estimated_at::DATE THEN 'on_time_delivered' "
            f"WHEN {arrived(run)} THEN 'late_delivered' "
            f"WHEN estimated_at::DATE < {run} THEN 'late_undelivered' ELSE 'unresolved' END")


def label(run):
    return (f"CASE {status(run)} WHEN 'on_time_delivered' THEN 0 WHEN 'late_delivered' THEN 1 "
            f"WHEN 'late_undelivered' THEN 1 END")


def target_status(run, w):
    lead = "date_diff('day', approved_at::DATE, delivered_at::DATE)"
    return (f"CASE WHEN NOT {valid(run)} THEN 'invalid_or_missing_dates' "
            f"WHEN {arrived(run)} AND {lead} <= {w} THEN 'delivered_within_waiting_period' "
            f"WHEN {arrived(run)} THEN 'capped_delivered' "
            f"WHEN date_diff('day', approved_at::DATE, {run}) >= {w} THEN 'capped_undelivered' ELSE 'unresolved' END")


def target(run, w):
    lead = "date_diff('day', approved_at::DATE, delivered_at::DATE)"
    st = target_status(run, w)
    return (f"(CASE {st} WHEN 'delivered_within_waiting_period' THEN {lead} WHEN 'capped_delivered' THEN {w} "
            f"WHEN 'capped_undelivered' THEN {w} END - date_diff('day', approved_at::DATE, estimated_at::DATE))::DOUBLE")


def frac_days(a, b):
    return f"(epoch_us({b}) - epoch_us({a})) / 86400000000.0::DOUBLE"


CUTOFF = "(approved_at::DATE + 46)"

VIEWS = {
    "r_orders": f"""SELECT {_K} AS order_id, o_custkey AS customer_id, o_orderdate AS purchase_ts,
        CASE WHEN {_K} % 600 <> 5 THEN o_orderdate + to_hours({_K} % 3) END AS approved_at,
        CASE WHEN NOT {_GONE} THEN o_orderdate + to_days((greatest({_LEAD}, 0) // 3)::INTEGER) END AS carrier_at,
        CASE WHEN NOT {_GONE} THEN o_orderdate + to_days(({_LEAD})::INTEGER) END AS delivered_at,
        o_orderdate + to_days((20 + 3 * ({_K} % 5))::INTEGER) AS estimated_at,
        CASE WHEN {_K} % 90 = 13 THEN 'canceled' WHEN {_K} % 40 = 7 THEN 'shipped' ELSE 'delivered' END AS order_status,
        o_orderpriority AS priority FROM orders""",
    "r_items": """SELECT l_orderkey AS order_id, l_linenumber AS item_seq, l_partkey AS product_id, l_suppkey AS seller_id,
        l_extendedprice AS price, floor(l_extendedprice * l_tax * 100 + 0.5::DOUBLE) / 100::DOUBLE AS freight_value, l_shipdate AS shipping_limit
        FROM lineitem""",
    "r_customers": """SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, c_nationkey AS customer_zip,
        n_name AS customer_city, r_name AS customer_state FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "r_sellers": """SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip, n_name AS seller_city, r_name AS seller_state
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "r_products": """SELECT p_partkey AS product_id, CASE WHEN p_partkey % 50 <> 0 THEN p_type END AS category,
        CASE WHEN p_partkey % 37 <> 0 THEN p_size * 100 END AS weight_g, 1 + p_size % 7 AS length_cm,
        1 + p_size % 5 AS height_cm, 1 + p_size % 3 AS width_cm, (1 + p_partkey % 5)::INTEGER AS photos FROM part""",
    "r_translation": "SELECT DISTINCT p_type AS category, lower(p_type) AS category_english FROM part WHERE p_type <> 'PROMO'",
    "r_payments": """SELECT l_orderkey AS order_id, l_linenumber AS payment_seq, l_returnflag || l_linestatus AS payment_type,
        floor(l_extendedprice * (1 - l_discount) * 100 + 0.5::DOUBLE) / 100::DOUBLE AS payment_value, 1 + l_linenumber % 6 AS installments FROM lineitem""",
    "r_reviews": """SELECT order_id AS review_id, order_id, (1 + (order_id * 7) % 5)::INTEGER AS score,
        CASE WHEN order_id % 3 = 0 THEN 'text' END AS comment, delivered_at + to_days(2) AS answered_at
        FROM r_orders WHERE order_id % 11 <> 0""",
    "r_geo": """SELECT c_nationkey AS zip, -33::DOUBLE + 1.4::DOUBLE * c_nationkey + 0.01::DOUBLE * (c_custkey % 7)
        + CASE WHEN c_custkey % 100 = 0 THEN 60::DOUBLE ELSE 0::DOUBLE END AS lat,
        -73::DOUBLE + 1.5::DOUBLE * c_nationkey + 0.01::DOUBLE * (c_custkey % 5) AS lng FROM customer""",
    "r_scores": f"""SELECT {_K} AS order_id, CASE WHEN {_K} % 400 <> 3 THEN (({_K} * 7919) % 1009) / 1009.0::DOUBLE END AS p,
        CASE WHEN {_K} % 400 <> 3 THEN ({_LEAD} - (20 + 3 * ({_K} % 5)) + {_K} % 7 - 3)::DOUBLE END AS days FROM orders""",
    "r_log": """SELECT event_id, ts, user_id, value / 100::DOUBLE AS score, event_type AS segment,
        (props::JSON ->> '$.k')::DOUBLE AS feature FROM events""",
    "f_zip": "SELECT zip, quantile_cont(lat, 0.5) AS lat, quantile_cont(lng, 0.5) AS lng FROM r_geo GROUP BY zip",
    "f_approved": """SELECT o.*, approved_at::DATE AS approved_day, strftime(approved_at, '%Y-%m') AS partition_yyyymm,
        c.customer_zip, c.customer_city, c.customer_state
        FROM r_orders o LEFT JOIN r_customers c USING (customer_id) WHERE approved_at IS NOT NULL""",
    "f_star": """SELECT i.*, p.category, p.weight_g, p.photos, p.length_cm * p.height_cm * p.width_cm AS volume,
        s.seller_zip, s.seller_city, s.seller_state FROM r_items i LEFT JOIN r_products p USING (product_id)
        LEFT JOIN r_sellers s USING (seller_id)""",
    "f_route": """SELECT order_id, CASE WHEN bool_and(x) THEN '1. All interstate' WHEN NOT bool_or(x) THEN '2. All same-state'
        ELSE '3. Mixed' END AS route_type FROM (SELECT a.order_id, coalesce(a.customer_state <> s.seller_state, true) AS x
        FROM f_approved a LEFT JOIN f_star s USING (order_id)) GROUP BY order_id""",
    "f_pairs": """SELECT order_id, seller_id, 2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
        pow(sin((radians(clat) - radians(slat)) / 2), 2) + cos(radians(slat)) * cos(radians(clat))
        * pow(sin((radians(clng) - radians(slng)) / 2), 2)))) AS distance_km
        FROM (SELECT i.order_id, i.seller_id, zs.lat AS slat, zs.lng AS slng, zc.lat AS clat, zc.lng AS clng
        FROM (SELECT DISTINCT order_id, seller_id FROM r_items) i LEFT JOIN r_sellers s USING (seller_id)
        LEFT JOIN f_zip zs ON zs.zip = s.seller_zip LEFT JOIN r_orders o USING (order_id)
        LEFT JOIN r_customers c USING (customer_id) LEFT JOIN f_zip zc ON zc.zip = c.customer_zip)""",
    "f_dist": """SELECT order_id, max(distance_km) AS seller_dist_km_max, min(distance_km) AS seller_dist_km_min,
        quantile_cont(distance_km, 0.5) AS seller_dist_km_median, avg(distance_km) AS seller_dist_km_mean,
        count(DISTINCT seller_id) AS seller_dist_km_count FROM f_pairs GROUP BY order_id""",
    "f_basket": """SELECT order_id, count(product_id) AS order_item_count, count(DISTINCT seller_id) AS order_seller_count,
        coalesce(sum(price), 0) AS order_pdt_price_sum, coalesce(sum(freight_value), 0) AS order_frieght_value_sum,
        coalesce(sum(price + freight_value), 0) AS order_revenue_sum,
        coalesce(sum(weight_g), 0)::DOUBLE AS order_product_weight_g_sum,
        count(DISTINCT category) AS order_product_category_count, count(DISTINCT seller_zip) AS seller_zip_code_prefix_count,
        count(DISTINCT seller_city) AS seller_city_count, count(DISTINCT seller_state) AS seller_state_count,
        sum(volume)::DOUBLE AS order_product_volume_cm3_sum, avg(photos) AS order_product_photos_mean
        FROM f_star GROUP BY order_id""",
    "f_pay": "SELECT order_id, sum(payment_value) AS payment_value_sum, " + ", ".join(
        f"coalesce(sum(payment_value) FILTER (WHERE payment_type = '{t}'), 0) AS payment_type_value_{t}, "
        f"count(*) FILTER (WHERE payment_type = '{t}') AS payment_type_count_{t}" for t in TYPES)
        + """, string_agg(DISTINCT payment_type, '+' ORDER BY payment_type) AS payment_combination,
        max(installments) AS payment_installments_max FROM r_payments GROUP BY order_id""",
    "f_daily": "SELECT approved_at::DATE AS d, count(*) AS c FROM r_orders WHERE approved_at IS NOT NULL GROUP BY 1",
    "f_load": """SELECT d, coalesce(sum(c) OVER (ORDER BY d RANGE BETWEEN INTERVAL 7 DAYS PRECEDING
        AND INTERVAL 1 DAY PRECEDING), 0)::BIGINT AS orders_approved_prev_7d FROM f_daily""",
    "feat": """SELECT a.*, isodow(approved_day) AS order_approved_day_of_week, day(approved_day) AS order_approved_day_of_month,
        month(approved_day) AS order_approved_month, least(weekofyear(approved_day), 52) AS order_approved_week_of_year,
        """ + frac_days("approved_at", "carrier_at") + " AS durn_to_carrier_days, "
        + frac_days("approved_at", "delivered_at") + """ AS durn_to_customer_days, route_type,
        f_dist.* EXCLUDE (order_id), f_basket.* EXCLUDE (order_id), f_pay.* EXCLUDE (order_id, payment_combination),
        coalesce(payment_combination, 'no_payment') AS payment_combination, orders_approved_prev_7d,
        date_diff('day', approved_day, estimated_at::DATE) AS promised_lead_days,
        (epoch_us(approved_at) - epoch_us(purchase_ts)) / 3600000000.0::DOUBLE AS approval_lag_hours,
        (isodow(approved_day) >= 6)::INTEGER AS is_weekend_approval,
        (approved_day BETWEEN DATE '2017-11-20' AND DATE '2017-11-30')::INTEGER AS is_black_friday_period,
        (month(approved_day) = 12)::INTEGER AS is_december_peak,
        order_frieght_value_sum / nullif(order_pdt_price_sum, 0) AS freight_to_price_ratio
        FROM f_approved a LEFT JOIN f_route USING (order_id) LEFT JOIN f_dist ON f_dist.order_id = a.order_id
        LEFT JOIN f_basket ON f_basket.order_id = a.order_id LEFT JOIN f_pay ON f_pay.order_id = a.order_id
        LEFT JOIN f_load ON f_load.d = a.approved_day WHERE partition_yyyymm >= '1995-02'""",
    "f_first": f"""SELECT order_id, arg_min(category, {ITEM_ORDER}) FILTER (WHERE category IS NOT NULL) AS primary_category,
        arg_min(seller_state, {ITEM_ORDER}) FILTER (WHERE seller_state IS NOT NULL) AS primary_seller_state
        FROM f_star GROUP BY order_id""",
    "f_review": """SELECT order_id, avg(score) AS review_score, bool_or(comment IS NOT NULL) AS has_review_comment
        FROM r_reviews GROUP BY order_id""",
    "ot": f"""SELECT order_id, customer_id, approved_day, date_trunc('month', approved_day)::DATE AS approved_month,
        isodow(purchase_ts) AS purchase_weekday, hour(purchase_ts) AS purchase_hour, order_status, customer_state, route_type,
        seller_dist_km_mean, order_item_count AS item_count, order_seller_count AS seller_count,
        order_product_category_count AS category_count, order_pdt_price_sum AS order_value,
        order_frieght_value_sum AS freight_value, payment_value_sum AS payment_value, payment_combination,
        payment_installments_max, promised_lead_days, approval_lag_hours, durn_to_carrier_days AS approval_to_carrier_days,
        durn_to_customer_days AS approval_to_customer_days, primary_category, primary_seller_state, review_score,
        has_review_comment, CASE WHEN order_status <> 'canceled' THEN {label(CUTOFF)} END AS late,
        CASE WHEN order_status = 'canceled' THEN 'canceled_or_unavailable' ELSE {status(CUTOFF)} END AS label_status,
        CASE WHEN order_status <> 'canceled' THEN {target(CUTOFF, 45)} END AS days_from_promise,
        CASE WHEN review_score <= 2 THEN 'Low (1-2)' WHEN review_score <= 4 THEN 'Mid (3-4)'
             WHEN review_score <= 5 THEN 'High (5)' END AS review_group
        FROM feat LEFT JOIN f_first USING (order_id) LEFT JOIN f_review USING (order_id)
        WHERE partition_yyyymm BETWEEN '1995-02' AND '2001-06'""",
    "od": "SELECT * REPLACE (CASE WHEN order_status = 'delivered' THEN late END AS late) FROM ot",
    "s_pairs": """SELECT p.order_id, p.seller_id, purchase_ts, approved_at, delivered_at,
        date_diff('day', estimated_at::DATE, delivered_at::DATE) AS deviation_days,
        (delivered_at::DATE > estimated_at::DATE)::INTEGER AS late
        FROM (SELECT DISTINCT order_id, seller_id FROM r_items) p JOIN r_orders USING (order_id)
        WHERE order_status = 'delivered' AND delivered_at IS NOT NULL""",
    "s_events": """SELECT seller_id, delivered_at, sum(sum(1)) OVER w AS prior_completed_orders,
        sum(sum(late)) OVER w AS prior_late_orders, sum(sum(deviation_days)) OVER w AS prior_deviation_sum
        FROM s_pairs GROUP BY seller_id, delivered_at WINDOW w AS (PARTITION BY seller_id ORDER BY delivered_at)""",
    "sh": """SELECT p.order_id, p.seller_id, p.late, p.deviation_days,
        coalesce(e.prior_completed_orders, 0)::BIGINT AS prior_completed_orders,
        e.prior_late_orders / e.prior_completed_orders::DOUBLE AS prior_late_rate,
        e.prior_deviation_sum / e.prior_completed_orders::DOUBLE AS prior_mean_deviation
        FROM (SELECT * FROM s_pairs WHERE approved_at IS NOT NULL) p ASOF LEFT JOIN s_events e
        ON p.seller_id = e.seller_id AND p.approved_at > e.delivered_at""",
    # Scored orders with labels at approval + 45 days.
    "scored": f"""SELECT o.order_id, customer_state, approved_at::DATE AS approval_day,
        strftime(approved_at, '%Y-%m') AS month, p, days, {label(CUTOFF)} AS label, {target(CUTOFF, 45)} AS target,
        date_diff('day', approved_at::DATE, estimated_at::DATE) AS promised_lead_days
        FROM r_orders o JOIN r_scores USING (order_id) LEFT JOIN r_customers USING (customer_id)
        WHERE p IS NOT NULL AND approved_at IS NOT NULL AND order_status <> 'canceled'
        AND (delivered_at IS NULL OR delivered_at::DATE > approved_at::DATE)""",
}


def sql(body: str) -> str:
    """``body`` with the views it uses, in dependency order."""
    need: list[str] = []

    def visit(text):
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(VIEWS[name])
                need.append(name)
    visit(body)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes}, {body.lstrip()[5:]}"
    return f"WITH {ctes} {body}"
