"""Point-in-time labels, audits, splits and folds."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.nulls import n_rows, percent
from ..functions.times import day, month_bounds, month_label
from ..operators import audits, cubes, features, labels, splits
from ..operators.labels import EXCLUDED_STATUSES
from ..roles import PAYMENT_TYPES
from .catalog import FIRST_MONTH, LAST_MONTH, RUN_DATE, query
from .oracle import CUTOFF, arrived, label, status, target, target_status

RUN = "DATE '1998-06-02'"
WINDOW = "approved_at::DATE BETWEEN DATE '1997-04-18' AND DATE '1998-04-17' AND order_status <> 'canceled'"
LEAD = "date_diff('day', approved_at::DATE, delivered_at::DATE)"


@query("required_dates", """SELECT DATE '1998-06-02' AS run_date, DATE '1998-06-02' - 1 - 45 - 364 AS start_day, DATE '1998-06-02' - 1 - 45 AS end_day,
    DATE '1998-06-02' - 1 AS inference_day, count(*) AS orders FROM r_orders WHERE approved_at::DATE BETWEEN DATE '1998-06-02' - 410 AND DATE '1998-06-02' - 46""")
def _(t):
    start, end, inference = labels.required_dates(RUN_DATE, 45, 365)
    return t.orders.where(day("approved_at").between(F.lit(start), F.lit(end))).agg(n_rows("orders")).select(
        F.lit(RUN_DATE).cast("date").alias("run_date"), F.lit(start).alias("start_day"), F.lit(end).alias("end_day"),
        F.lit(inference).alias("inference_day"), "orders")


@query("labels_as_of", f"SELECT order_id, {arrived(RUN)} AS delivered_by_run, {label(RUN)}::BIGINT AS label, {status(RUN)} AS label_status FROM r_orders")
def _(t):
    return labels.labels_as_of(t.orders, RUN_DATE).select("order_id", "delivered_by_run", "label", "label_status")


@query("regression_targets_as_of", f"""SELECT order_id, {target(RUN, 45)} AS target, {target_status(RUN, 45)} AS target_status,
    CASE {target_status(RUN, 45)} WHEN 'delivered_within_waiting_period' THEN {LEAD}::DOUBLE WHEN 'capped_delivered' THEN 45.0::DOUBLE WHEN 'capped_undelivered' THEN 45.0::DOUBLE END AS capped_lead FROM r_orders""")
def _(t):
    return labels.targets_as_of(t.orders, RUN_DATE, 45).select("order_id", "target", "target_status", "capped_lead")


@query("attach_prediction_labels", f"""SELECT order_id, {label(CUTOFF)}::BIGINT AS actual_label, {status(CUTOFF)} AS label_status,
    approved_at::DATE + 45 AS evaluation_cutoff, (p >= 0.5)::BIGINT AS predicted_label FROM r_scores JOIN r_orders USING (order_id)""")
def _(t):
    return labels.attach_prediction_labels(t.scores, t.orders, 45, 0.5).select(
        "order_id", "actual_label", "label_status", "evaluation_cutoff", "predicted_label")


@query("attach_regression_actuals", f"""SELECT order_id, {target(CUTOFF, 45)} AS actual_target, {target_status(CUTOFF, 45)} AS target_status,
    approved_at::DATE + 45 AS evaluation_cutoff FROM r_scores JOIN r_orders USING (order_id)""")
def _(t):
    return labels.attach_regression_actuals(t.scores, t.orders, 45).select("order_id", "actual_target", "target_status", "evaluation_cutoff")


@query("cancel_override", f"""SELECT order_id, CASE WHEN order_status <> 'canceled' THEN {label(CUTOFF)} END::BIGINT AS label,
    CASE WHEN order_status = 'canceled' THEN 'canceled_or_unavailable' ELSE {status(CUTOFF)} END AS label_status FROM r_orders""")
def _(t):
    rows = labels.labels_as_of(t.orders, F.date_add(day("approved_at"), 46))
    return labels.cancel_override(rows).select("order_id", "label", "label_status")


ELIGIBLE = "approved_at IS NOT NULL AND (delivered_at IS NULL OR delivered_at::DATE > approved_at::DATE)"


@query("scoring_eligibility", f"SELECT order_id, approved_at::DATE AS approval_day FROM r_orders WHERE {ELIGIBLE} AND approved_at::DATE BETWEEN DATE '1998-06-01' AND DATE '1998-08-31'")
def _(t):
    return labels.scoring_eligibility(t.orders, "1998-06-01", "1998-08-31").select("order_id", day("approved_at").alias("approval_day"))


@query("month_bounds", """SELECT strftime(approved_at, '%Y-%m') AS month, date_trunc('month', min(approved_at))::DATE AS first_day, last_day(min(approved_at)::DATE) AS final_day, count(*) AS orders
    FROM r_orders WHERE approved_at::DATE BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' GROUP BY 1""")
def _(t):
    lo, hi = month_bounds("1998-02")
    return t.orders.where(day("approved_at").between(lo, hi)).groupBy(month_label("approved_at").alias("month")).agg(
        F.trunc(F.min(day("approved_at")), "MM").alias("first_day"), F.last_day(F.min(day("approved_at"))).alias("final_day"), n_rows("orders"))


RETRO = f"""retro AS (SELECT o.order_id, approved_at::DATE AS approval_day, {label(CUTOFF)}::BIGINT AS late, v.score::BIGINT AS review_score FROM r_orders o
    LEFT JOIN r_reviews v USING (order_id) WHERE {ELIGIBLE} AND order_status <> 'canceled' AND strftime(approved_at, '%Y-%m') BETWEEN '{FIRST_MONTH}' AND '{LAST_MONTH}')"""


def _retro(t):
    return labels.retrospective_outcomes(t.orders, t.reviews, 45, FIRST_MONTH, LAST_MONTH)


@query("retrospective_outcomes", f"WITH {RETRO} SELECT * FROM retro")
def _(t):
    return _retro(t)


@query("daily_outcome_table", f"""WITH {RETRO} SELECT approval_day, count(*) AS orders, count(late) AS known, coalesce(sum(late), 0)::BIGINT AS late,
    round(100.0 * sum(late) / nullif(count(late), 0)::DOUBLE, 6) AS late_rate_pct FROM retro GROUP BY 1""")
def _(t):
    return audits.daily_outcomes(_retro(t))


@query("training_window", f"""SELECT 'classification' AS task, order_id, {label(RUN)}::DOUBLE AS y FROM r_orders WHERE {WINDOW} AND {label(RUN)} IS NOT NULL UNION ALL
    SELECT 'regression', order_id, {target(RUN, 45)} FROM r_orders WHERE {WINDOW} AND {target(RUN, 45)} IS NOT NULL""")
def _(t):
    return audits.union_all([labels.training_window(t.orders, RUN_DATE, k).select(F.lit(k).alias("task"), "order_id", "y")
                             for k in ("classification", "regression")])


# ---- audits ----

GRAINS = {"orders": ("r_orders", ["order_id"]), "items": ("r_items", ["order_id", "item_seq"]), "customers": ("r_customers", ["customer_id"]),
          "geolocation": ("r_geo", ["zip"])}
COLS = {"orders": ["order_id", "customer_id", "purchase_ts", "approved_at", "carrier_at", "delivered_at", "estimated_at", "order_status", "priority"],
        "items": ["order_id", "item_seq", "product_id", "seller_id", "price", "freight_value", "shipping_limit"],
        "customers": ["customer_id", "customer_zip", "customer_city", "customer_state", "customer_unique_id"], "geolocation": ["zip", "lat", "lng"]}


def _inventory(name):
    view, keys = GRAINS[name]
    cells = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in COLS[name])
    return f"""SELECT '{name}' AS table_name, count(*) AS rows, {len(COLS[name])}::BIGINT AS columns, ({cells})::BIGINT AS missing_cells,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {view})) AS duplicate_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {view})) AS repeated_keys FROM {view}"""


@query("table_inventory", f"""SELECT *, round(100.0 * missing_cells / (rows * columns)::DOUBLE, 6) AS missing_pct, repeated_keys = 0 AS grain_unique
    FROM ({' UNION ALL '.join(_inventory(n) for n in GRAINS)})""")
def _(t):
    return audits.table_inventory({"orders": t.orders, "items": t.items, "customers": t.customers, "geolocation": t.geolocation},
                                  {k: v[1] for k, v in GRAINS.items()})


MISS = ["approved_at", "carrier_at", "delivered_at", "order_status", "priority"]


@query("missing_profile", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(DISTINCT {c}) AS n_unique,
    round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)::DOUBLE, 6) AS missing_pct FROM r_orders""" for c in MISS))
def _(t):
    return audits.missing_profile(t.orders, MISS)


@query("missing_by_status", "SELECT order_status, count(*) AS orders, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS missing_{c}" for c in MISS[:3]) + " FROM r_orders GROUP BY 1")
def _(t):
    return audits.missing_by_status(t.orders, MISS[:3])


FKS = [("orders-customers", "orders", "customer_id", "customers", "customer_id"), ("items-orders", "items", "order_id", "orders", "order_id"),
       ("items-products", "items", "product_id", "products", "product_id"), ("items-sellers", "items", "seller_id", "sellers", "seller_id"),
       ("payments-orders", "payments", "order_id", "orders", "order_id"), ("products-translation", "products", "category", "translation", "category")]


@query("referential_integrity", " UNION ALL ".join(f"""SELECT '{n}' AS check_name, count(*) AS rows, count(*) FILTER (WHERE p.k IS NULL) AS unmatched,
    round(100.0 * count(*) FILTER (WHERE p.k IS NULL) / count(*)::DOUBLE, 6) AS unmatched_pct FROM r_{c} c LEFT JOIN (SELECT DISTINCT {pk} AS k FROM r_{p}) p ON c.{ck} = p.k""" for n, c, ck, p, pk in FKS))
def _(t):
    return audits.referential_integrity([(n, getattr(t, c), ck, getattr(t, p), pk) for n, c, ck, p, pk in FKS])


@query("fanout_stats", """WITH c AS (SELECT o.order_id, c FROM r_orders o LEFT JOIN (SELECT order_id, count(*) AS c FROM r_items GROUP BY 1) USING (order_id))
    SELECT count(*) AS parents, count(c) AS parents_with_children, sum(c)::BIGINT AS children, round(avg(c), 6) AS mean_children, round(stddev_samp(c), 6) AS sd_children,
    min(c) AS min_children, quantile_cont(c, 0.25) AS p25, quantile_cont(c, 0.5) AS median_children, quantile_cont(c, 0.75) AS p75, max(c) AS max_children FROM c""")
def _(t):
    return audits.fanout_stats(t.orders, t.items, "order_id")


@query("coverage_gaps", """SELECT 'no items' AS gap, count(*) AS orders FROM r_orders WHERE order_id NOT IN (SELECT order_id FROM r_items) UNION ALL
    SELECT 'no payment', count(*) FROM r_orders WHERE order_id NOT IN (SELECT order_id FROM r_payments) UNION ALL
    SELECT 'no review', count(*) FROM r_orders WHERE order_id NOT IN (SELECT order_id FROM r_reviews) UNION ALL
    SELECT 'more than one review', count(*) FROM (SELECT order_id FROM r_reviews GROUP BY 1 HAVING count(*) > 1)""")
def _(t):
    return audits.coverage_gaps(t.orders, t.items, t.payments, t.reviews)


@query("monthly_coverage", """SELECT strftime(purchase_ts, '%Y-%m') AS month, count(*) AS orders, count(approved_at) AS approved, count(delivered_at) AS delivered, min(purchase_ts)::DATE AS first_day,
    max(purchase_ts)::DATE AS last_day, count(DISTINCT purchase_ts::DATE) AS observed_days, round(count(*) / count(DISTINCT purchase_ts::DATE)::DOUBLE, 6) AS orders_per_day,
    date_diff('day', min(purchase_ts)::DATE, max(purchase_ts)::DATE) + 1 AS span_days, count(DISTINCT purchase_ts::DATE) < 28 AS thin_month FROM r_orders GROUP BY 1""")
def _(t):
    return audits.monthly_coverage(t.orders)


KEPT = f"approved_at IS NOT NULL AND strftime(approved_at, '%Y-%m') >= '{FIRST_MONTH}'"


@query("cleaning_steps", f"""SELECT * FROM (SELECT 0::BIGINT AS step_no, 'raw orders' AS step, count(*) AS orders FROM r_orders UNION ALL SELECT 1, 'without approval', count(*) FROM r_orders WHERE approved_at IS NULL
    UNION ALL SELECT 2, 'approved orders', count(approved_at) FROM r_orders UNION ALL SELECT 3, 'approved before the first month', count(*) FROM r_orders WHERE approved_at IS NOT NULL AND NOT ({KEPT})
    UNION ALL SELECT 4, 'feature population', count(*) FROM r_orders WHERE {KEPT} UNION ALL SELECT 5, 'delivered before approval (kept)', count(*) FROM r_orders WHERE {KEPT} AND delivered_at::DATE < approved_at::DATE
    UNION ALL SELECT 6, 'canceled or unavailable (kept)', count(*) FROM r_orders WHERE {KEPT} AND order_status = 'canceled')""")
def _(t):
    return audits.cleaning_steps(t.orders, FIRST_MONTH)


# History, split and availability of the classification task, in SQL.
TASK = f"""hist AS (SELECT *, {label(RUN)} AS y FROM r_orders WHERE {WINDOW} AND {label(RUN)} IS NOT NULL),
    b AS (SELECT max(approved_at::DATE) - 29 AS ts FROM hist), vs AS (SELECT min(approved_at::DATE) AS v FROM hist, b WHERE approved_at::DATE >= ts),
    task AS (SELECT hist.*, CASE WHEN approved_at::DATE >= ts THEN 'test' WHEN approved_at::DATE < ts - 45 AND {label('v')} = y THEN 'train' END AS split FROM hist, b, vs)"""


def _task(t, source=None):
    """History rows of the classification task; train keeps only outcomes known at validation start."""
    history = splits.chronological_split(labels.training_window(source if source is not None else t.orders, RUN_DATE, "classification"), 30, 45)
    start = history.where("split = 'test'").agg(F.min(day("approved_at"))).first()[0]
    seen = labels.labels_as_of(history.withColumnsRenamed({"label": "_l", "label_status": "_s", "delivered_by_run": "_d"}), start)
    keep = (F.col("split") != "train") | (F.col("label").cast("double") == F.col("y"))
    return seen.withColumn("split", F.when(keep, F.col("split"))).drop("label", "label_status", "delivered_by_run") \
        .withColumnsRenamed({"_l": "label", "_s": "label_status", "_d": "delivered_by_run"})


@query("population_funnel", f"""WITH {TASK} SELECT 0::BIGINT AS step_no, 'approved in window' AS step, count(*) AS orders FROM r_orders WHERE approved_at::DATE BETWEEN DATE '1997-04-18' AND DATE '1998-04-17'
    UNION ALL SELECT 1, 'after dropping canceled', count(*) FROM r_orders WHERE {WINDOW} UNION ALL SELECT 2, 'outcome known', count(*) FROM task UNION ALL SELECT 3, 'validation', count(*) FROM task WHERE split = 'test'
    UNION ALL SELECT 4, 'gap or not yet known', count(*) FROM task WHERE split IS NULL UNION ALL SELECT 5, 'train', count(*) FROM task WHERE split = 'train'""")
def _(t):
    start, end, _ = labels.required_dates(RUN_DATE, 45, 365)
    return audits.population_funnel(t.orders.where(day("approved_at").between(F.lit(start), F.lit(end))), _task(t))


@query("target_summary", f"""WITH {TASK}, x AS (SELECT 'history' AS part, y FROM task UNION ALL SELECT split, y FROM task WHERE split IS NOT NULL)
    SELECT part, count(*) AS orders, round(avg(y), 6) AS mean_y, quantile_cont(y, 0.5)::DOUBLE AS median_y, round(stddev_samp(y), 6) AS sd_y, round(100 * avg((y > 0)::INTEGER), 6) AS late_share_pct FROM x GROUP BY 1""")
def _(t):
    return audits.target_summary(_task(t))


RUNS, BUFFERS = ["1997-06-02", "1998-06-02"], [15, 30, 45]


def _buffer_sql():
    parts = []
    for r in RUNS:
        for b in BUFFERS:
            for scope, lo in (("full window", f"DATE '{r}' - 1 - {b} - 364"), ("newest 7 days", f"DATE '{r}' - 1 - {b} - 6")):
                parts.append(f"""SELECT DATE '{r}' AS run_date, {b}::BIGINT AS buffer_days, '{scope}' AS scope, {label(f"DATE '{r}'")} AS y FROM r_orders
                    WHERE approved_at::DATE BETWEEN {lo} AND DATE '{r}' - 1 - {b}""")
    return f"""review AS (SELECT run_date, buffer_days, scope, count(*) AS orders, count(y) AS known_labels, count(*) - count(y) AS unknown_labels,
        100.0 * count(*) FILTER (WHERE y = 1) / nullif(count(y), 0)::DOUBLE AS late_rate_pct, 100.0 * count(y) / count(*)::DOUBLE AS completeness_pct FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2, 3)"""


@query("buffer_label_audit", f"WITH {_buffer_sql()} SELECT * REPLACE (round(late_rate_pct, 6) AS late_rate_pct, round(completeness_pct, 6) AS completeness_pct), completeness_pct >= 99 AS meets_target FROM review")
def _(t):
    return audits.buffer_label_audit(t.orders, RUNS, BUFFERS, 365)


@query("buffer_label_summary", f"WITH {_buffer_sql()} SELECT buffer_days, round(min(completeness_pct), 6) AS worst_completeness_pct, bool_and(completeness_pct >= 99) AS meets_target_everywhere FROM review GROUP BY 1")
def _(t):
    return audits.buffer_summary(audits.buffer_label_audit(t.orders, RUNS, BUFFERS, 365))


@query("label_availability", f"SELECT {status(RUN)} AS label_status, count(*) AS orders, round(100.0 * count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share_pct FROM r_orders WHERE {WINDOW} GROUP BY 1")
def _(t):
    start, end, _ = labels.required_dates(RUN_DATE, 45, 365)
    return audits.label_availability(t.orders.where(day("approved_at").between(F.lit(start), F.lit(end))), RUN_DATE)


def _waiting_sql():
    parts = [f"""SELECT DATE '{r}' AS run_date, {w}::BIGINT AS waiting_period, {target_status(f"DATE '{r}'", w)} AS st, date_diff('day', approved_at::DATE, estimated_at::DATE) > {w} AS early
        FROM r_orders WHERE approved_at::DATE BETWEEN DATE '{r}' - 410 AND DATE '{r}' - 46 AND order_status <> 'canceled'""" for r in RUNS for w in (25, 45)]
    pct = lambda c: f"round(100.0 * avg(({c})::INTEGER), 6)"
    capped = "st IN ('capped_delivered', 'capped_undelivered')"
    return f"""SELECT run_date, waiting_period, count(*) AS orders, {pct("st NOT IN ('unresolved', 'invalid_or_missing_dates')")} AS known_pct, {pct(capped)} AS capped_pct,
        {pct(capped + ' AND early')} AS capped_before_promise_pct, {pct("st = 'unresolved'")} AS unresolved_pct FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2"""


@query("waiting_period_audit", _waiting_sql())
def _(t):
    return audits.waiting_period_audit(t.orders, RUNS, [25, 45], 45, 365)


@query("route_audit", f"""WITH x AS (SELECT route_type, seller_state_count, {label(RUN)} AS y, {target(RUN, 45)} AS tg FROM feat WHERE {WINDOW} AND {label(RUN)} IS NOT NULL),
    g AS (SELECT route_type AS "group", y, tg FROM x UNION ALL SELECT 'seller_state_count >= 2', y, tg FROM x WHERE seller_state_count >= 2)
    SELECT "group", count(*) AS orders, sum(y)::BIGINT AS late_orders, round(100.0 * avg(y), 6) AS late_rate_pct, round(avg(tg), 6) AS mean_days_from_promise FROM g GROUP BY 1""")
def _(t):
    rows = labels.training_window(t.features, RUN_DATE, "classification")
    return audits.route_audit(labels.targets_as_of(rows, RUN_DATE, 45))


@query("exact_overlap_audit", """SELECT 'revenue' AS comparison, count(order_revenue_sum) AS rows, 1.0::DOUBLE AS equal_fraction FROM feat UNION ALL
    SELECT 'payment types', count(payment_value_sum), 1.0::DOUBLE FROM feat UNION ALL
    SELECT 'mean at least min', count(seller_dist_km_mean), avg((abs(seller_dist_km_mean - seller_dist_km_min) <= 1e-6)::INTEGER) FROM feat""".replace("avg((abs", "round(avg((abs").replace("::INTEGER) FROM", "::INTEGER), 6) FROM"))
def _(t):
    from functools import reduce
    total = reduce(lambda a, b: a + b, [F.col(f"payment_type_value_{x}") for x in PAYMENT_TYPES])
    return audits.exact_overlap(t.features, {
        "revenue": F.col("order_revenue_sum") - F.col("order_pdt_price_sum") - F.col("order_frieght_value_sum"),
        "payment types": F.col("payment_value_sum") - total,
        "mean at least min": F.col("seller_dist_km_mean") - F.col("seller_dist_km_min")}, tol=1e-6).drop("max_abs_difference")


@query("cohort_counts", f"""SELECT strftime(approved_at, '%Y-%m') AS month, count(*) AS scored, count({label(CUTOFF)}) AS evaluated, coalesce(sum({label(CUTOFF)}), 0)::BIGINT AS late
    FROM r_orders WHERE {ELIGIBLE} AND order_status <> 'canceled' AND strftime(approved_at, '%Y-%m') BETWEEN '1998-06' AND '1998-08' GROUP BY 1""")
def _(t):
    return audits.cohort_counts(t.orders, ("1998-06", "1998-08"))


@query("review_group_retrospective", f"""WITH {RETRO} SELECT CASE WHEN review_score <= 2 THEN 'Low (1-2)' WHEN review_score <= 4 THEN 'Mid (3-4)' ELSE 'High (5)' END AS review_group, count(*) AS orders,
    sum(late)::BIGINT AS late, round(100.0 * sum(late) / count(*)::DOUBLE, 6) AS late_rate_pct FROM retro WHERE late IS NOT NULL AND review_score IS NOT NULL GROUP BY 1""")
def _(t):
    return cubes.review_group_late(_retro(t))


@query("leakage_guard", f"""WITH {TASK} SELECT 'outcome columns used' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'shared order ids', count(*) FROM task WHERE split = 'train' AND order_id IN (SELECT order_id FROM task WHERE split = 'test')
    UNION ALL SELECT 'train day on or after validation', count(*) FROM task, vs WHERE split = 'train' AND approved_at::DATE >= v""")
def _(t):
    rows = _task(t)
    return audits.leakage_guard(rows.where("split = 'train'"), rows.where("split = 'test'"), features.SELECTED_NUMERIC)


# ---- splits and folds ----

@query("chronological_split", f"""WITH h AS (SELECT order_id, approved_at::DATE AS d FROM r_orders WHERE {WINDOW} AND {label(RUN)} IS NOT NULL), b AS (SELECT max(d) - 29 AS ts FROM h)
    SELECT order_id, CASE WHEN d >= ts THEN 'test' WHEN d < ts - 45 THEN 'train' END AS split FROM h, b""")
def _(t):
    return splits.chronological_split(labels.training_window(t.orders, RUN_DATE, "classification"), 30, 45).select("order_id", "split")


@query("available_training_rows", f"WITH {TASK} SELECT order_id, y::DOUBLE AS y FROM task WHERE split = 'train'")
def _(t):
    history = splits.chronological_split(labels.training_window(t.orders, RUN_DATE, "classification"), 30, 45)
    start = history.where("split = 'test'").agg(F.min(day("approved_at"))).first()[0]
    train = history.where("split = 'train'").select("order_id", *labels.DATE_COLS, "y")
    return splits.available_training_rows(train, start, labels.labels_as_of, "label").select("order_id", "y")


FOLDS = f"""{TASK}, tr AS (SELECT * FROM task WHERE split = 'train'), mx AS (SELECT max(approved_at::DATE) AS m FROM tr),
    plan AS (SELECT i::BIGINT AS fold, m - 149 + 30 * (i - 1)::INTEGER AS vs, m - 149 + 30 * i::INTEGER - 1 AS ve FROM mx, range(1, 6) r(i)),
    folds AS (SELECT tr.*, fold, vs, CASE WHEN approved_at::DATE < vs - 45 THEN 'train' ELSE 'valid' END AS role FROM tr, plan WHERE approved_at::DATE < vs - 45 OR approved_at::DATE BETWEEN vs AND ve)"""


def _folds(t, source=None):
    train = _task(t, source).where("split = 'train'")
    return splits.day_blocked_folds(train, n_splits=5, gap_days=45, validation_days=30)


@query("day_blocked_folds", f"WITH {FOLDS} SELECT fold, order_id, role FROM folds")
def _(t):
    return _folds(t).select("fold", "order_id", "role")


@query("day_blocked_folds_equal", """WITH d AS (SELECT DISTINCT approved_at::DATE AS d FROM r_orders WHERE approved_at IS NOT NULL), r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM d),
    k AS (SELECT d, CASE WHEN i < (n % 6) * (n // 6 + 1) THEN i // (n // 6 + 1) ELSE (n % 6) + (i - (n % 6) * (n // 6 + 1)) // (n // 6) END AS blk FROM r),
    p AS (SELECT blk::BIGINT AS fold, min(d) AS vs, max(d) AS ve FROM k WHERE blk > 0 GROUP BY 1)
    SELECT fold, CASE WHEN approved_at::DATE < vs - 10 THEN 'train' ELSE 'valid' END AS role, count(*) AS rows FROM r_orders, p WHERE approved_at::DATE < vs - 10 OR approved_at::DATE BETWEEN vs AND ve GROUP BY 1, 2""")
def _(t):
    return splits.day_blocked_folds(t.orders, n_splits=5, gap_days=10).groupBy("fold", "role").agg(n_rows("rows"))


AVAILABLE = f"""{FOLDS}, st AS (SELECT fold, min(approved_at::DATE) AS v FROM folds WHERE role = 'valid' GROUP BY 1),
    kept AS (SELECT * FROM folds JOIN st USING (fold) WHERE role = 'valid' OR {label('v')} = y)"""


def available_folds(t, source=None):
    return splits.available_outcome_folds(_folds(t, source).drop("label", "label_status", "delivered_by_run"), labels.labels_as_of, "label")


@query("available_outcome_folds", f"WITH {AVAILABLE} SELECT fold, order_id, role FROM kept")
def _(t):
    return available_folds(t).select("fold", "order_id", "role")


@query("fold_summary", f"WITH {AVAILABLE} SELECT fold, role, count(*) AS rows, min(approved_at::DATE) AS first_day, max(approved_at::DATE) AS last_day, round(avg(y), 6) AS mean_y FROM kept GROUP BY 1, 2")
def _(t):
    return splits.fold_summary(available_folds(t))


@query("random_stratified_split", f"""WITH c AS (SELECT {label(RUN)}::BIGINT AS label, count(*) AS n FROM r_orders WHERE {WINDOW} AND {label(RUN)} IS NOT NULL GROUP BY 1)
    SELECT label, 'test' AS split, floor(0.2::DOUBLE * n)::BIGINT AS rows FROM c UNION ALL SELECT label, 'train', n - floor(0.2::DOUBLE * n)::BIGINT FROM c""")
def _(t):
    rows = labels.training_window(t.orders, RUN_DATE, "classification").select("order_id", "label")
    return splits.stratified_split(rows, "label", 0.2).groupBy("label", "split").agg(n_rows("rows"))
