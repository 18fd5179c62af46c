"""Design, linear statistics, selection, pyspark.ml models and interpretation."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import n_rows
from ..functions.times import day, month_label
from ..operators import cubes, design, features, labels, logit, metrics, ml, ordering, splits, stats, trees
from ..operators.audits import union_all
from ..roles import PAYMENT_TYPES
from ..session import shared_path
from .catalog import RUN_DATE, query
from .labels_and_audits import RUN, TASK, WINDOW
from .oracle import TYPES, label, target

NUM = features.SELECTED_NUMERIC
CAT = ["customer_state", "route_type"]
LOGS = ["payment_value_sum", "order_frieght_value_sum", "order_product_weight_g_sum"]
# Parameters of the reference's models and searches.
TREE = {"maxDepth": 12, "minInstancesPerNode": 20, "impurity": "gini"}
FOREST = {"numTrees": 500, "maxDepth": 12, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt", "subsamplingRate": 0.5, "impurity": "gini"}
BOOST = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1}
STAGE_A, STAGE_A_TREES, STAGE_B_TREES, REPEATS = 60, 200, (300, 500), 5
_WRITTEN: dict[tuple, str] = {}


def _input_state(t) -> str:
    """Newest change and number of the files of the order tables; from file metadata alone."""
    tables = [t.raw(name).select("_metadata.file_path", "_metadata.file_modification_time") for name in ("orders", "lineitem")]
    return str(union_all(tables).agg(F.max("file_modification_time"), F.count_distinct("file_path")).first())


def written(t, name: str, build) -> DataFrame:
    """A table written once per session and state of its input files, and read by every later fit."""
    key = (t.spark.sparkContext.applicationId, t.path, _input_state(t), name)
    if key not in _WRITTEN:
        path = shared_path(t.spark, name)
        build().write.option("compression", "zstd").parquet(path)
        _WRITTEN[key] = path
    return t.spark.read.parquet(_WRITTEN[key])


def feature_rows(t) -> DataFrame:
    return written(t, "features", lambda: t.features.drop("product_categories", "seller_zips", "seller_cities", "seller_states"))


def task_rows(t, task: str = "classification") -> DataFrame:
    """History of a task with ``y``, ``label``, ``target`` and ``split``; train holds outcomes known at validation start."""
    def build():
        rows = splits.chronological_split(labels.training_window(feature_rows(t), RUN_DATE, task), 30, 45)
        start = rows.where("split = 'test'").agg(F.min(day("approved_at"))).first()[0]
        if task == "classification":
            rows = splits.known_outcomes(labels.targets_as_of(rows, RUN_DATE, 45), start, labels.labels_as_of, "label")
        else:
            rows = splits.known_outcomes(rows, start, lambda df, run: labels.targets_as_of(df, run, 45), "target")
        keep = (F.col("split") != "train") | F.coalesce(F.col("_seen").cast("double") == F.col("y"), F.lit(False))
        return rows.withColumn("split", F.when(keep, F.col("split"))).drop("_seen").withColumn("month", month_label("approved_at"))
    return written(t, f"task-{task}", build)


def train_rows(t, task="classification"):
    return task_rows(t, task).where("split = 'train'")


def test_rows(t, task="classification"):
    return task_rows(t, task).where("split = 'test'")


def folds(t, task="classification") -> DataFrame:
    def build():
        plan = splits.day_blocked_folds(train_rows(t, task), n_splits=5, gap_days=45, validation_days=30)
        if task == "classification":
            kept = splits.available_outcome_folds(plan.drop("label", "label_status", "delivered_by_run"), labels.labels_as_of, "label")
            return kept.withColumn("label", F.col("y").cast("int"))
        w = lambda df, run: labels.targets_as_of(df, run, 45)
        return splits.available_outcome_folds(plan.drop("target", "target_status", "capped_lead"), w, "target")
    return written(t, f"folds-{task}", build)


def rows_df(t, rows, schema) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return t.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def logit_spec(name="C1", num=NUM, cat=CAT, **kw):
    return ml.Spec(name, "classification", ml.logistic, num, cat, scale=True, options={"log_cols": [c for c in LOGS if c in num], "cyclic": True, "merge_mixed_route": True}, **kw)


def linear_spec(name="R1", num=NUM, cat=CAT):
    return ml.Spec(name, "regression", ml.linear, num, cat, scale=True, options={"log_cols": [c for c in LOGS if c in num], "cyclic": True, "merge_mixed_route": True})


def tree_spec(task, name="tree", num=NUM, cat=CAT, weight=None, **p):
    return ml.Spec(name, task, lambda: ml.tree(task, **p), num, cat, weight=weight)


def forest_spec(task, name="forest", num=NUM, cat=CAT, weight=None, **p):
    return ml.Spec(name, task, lambda: ml.forest(task, **{**FOREST, **p}), num, cat, weight=weight)


# ---- preprocessing and catalogues ----

TR = f"{TASK}, tr AS (SELECT f.* FROM feat f JOIN task USING (order_id) WHERE task.split = 'train')"
IMP = ["seller_dist_km_mean", "payment_value_sum", "order_item_count"]


@query("median_impute", f"WITH {TR}, md AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in IMP) + " FROM tr) SELECT order_id, "
       + ", ".join(f"round(coalesce({c}, m_{c})::DOUBLE, 4) AS {c}" for c in IMP) + " FROM tr, md", digits=4)
def _(t):
    rows = train_rows(t)
    d = design.fit_design(rows, IMP, [], scale=False)
    return d.encode(rows, keep=["order_id"])


@query("standardise", f"WITH {TR}, md AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in IMP) + " FROM tr), fi AS (SELECT order_id, "
       + ", ".join(f"coalesce({c}, m_{c})::DOUBLE AS {c}" for c in IMP) + " FROM tr, md), mo AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in IMP)
       + " FROM fi) SELECT order_id, " + ", ".join(f"round(({c} - a_{c}) / s_{c}, 5) AS {c}" for c in IMP) + " FROM fi, mo", digits=5)
def _(t):
    rows = train_rows(t)
    return design.fit_design(rows, IMP, []).encode(rows, keep=["order_id"])


@query("one_hot_reference", f"""WITH {TR} SELECT order_id, (coalesce(customer_state = 'AFRICA', false))::INTEGER::DOUBLE AS "customer_state_AFRICA", (customer_state = 'AMERICA')::INTEGER::DOUBLE AS "customer_state_AMERICA",
    (customer_state = 'EUROPE')::INTEGER::DOUBLE AS "customer_state_EUROPE", (customer_state = 'MIDDLE EAST')::INTEGER::DOUBLE AS "customer_state_MIDDLE EAST" FROM tr""")
def _(t):
    rows = train_rows(t)
    levels = [v for v, _ in design.category_counts(rows, ["customer_state"])["customer_state"]]
    d = design.Design([], ["customer_state"], {}, levels={"customer_state": levels}, references={"customer_state": "ASIA"})
    return d.encode(rows, keep=["order_id"])


@query("linear_design")
def _(t):
    rows = train_rows(t)
    return design.fit_design(rows, NUM, CAT, log_cols=LOGS, cyclic=True, merge_mixed_route=True).encode(rows, keep=["order_id"])


@query("encoded_block_summary", f"""WITH {TR}, c AS (SELECT 'customer_state' AS block, customer_state AS v, count(*) AS n FROM tr WHERE customer_state IS NOT NULL GROUP BY 2 UNION ALL SELECT 'route_type', route_type, count(*) FROM tr WHERE route_type IS NOT NULL GROUP BY 2),
    eb AS (SELECT block, 1::BIGINT AS raw_columns, count(*) AS levels_seen, arg_min(v, (-n, v)) AS reference_dropped, count(*) - 1 AS encoded_columns FROM c GROUP BY 1 UNION ALL SELECT 'numeric', {len(NUM)}, NULL, '', {len(NUM)})
    SELECT * FROM eb UNION ALL SELECT 'total', sum(raw_columns)::BIGINT, NULL, '', sum(encoded_columns)::BIGINT FROM eb""")
def _(t):
    d = design.fit_design(train_rows(t), NUM, CAT, scale=False)
    rows = [{"block": "numeric", "raw_columns": len(NUM), "levels_seen": None, "reference_dropped": "", "encoded_columns": len(d.terms)}]
    rows += [{"block": c, "raw_columns": 1, "levels_seen": len(d.levels[c]), "reference_dropped": d.references[c], "encoded_columns": len(d.units[c])} for c in CAT]
    rows.append({"block": "total", "raw_columns": sum(r["raw_columns"] for r in rows), "levels_seen": None, "reference_dropped": "", "encoded_columns": sum(r["encoded_columns"] for r in rows)})
    return rows_df(t, rows, "block string, raw_columns int, levels_seen int, reference_dropped string, encoded_columns int")


GROUPS = {"Approval calendar": features.CALENDAR_COLS, "Basket contents": features.BASKET_COLS, "Seller location": features.DISTANCE_COLS + features.PLACE_COUNT_COLS,
          "Payment": ["payment_value_sum"] + features.payment_cols(PAYMENT_TYPES), "Approval-time extras": features.EXTRA_COLS, "Categorical": features.CATEGORICAL_COLS}


@query("feature_catalog", " UNION ALL ".join(f"SELECT '{g}' AS feature_group, '{c}' AS feature, {str(c in NUM or g == 'Categorical').lower()} AS kept, count(*) - count({c}) AS missing FROM feat" for g, cols in GROUPS.items() for c in cols))
def _(t):
    """Feature, group and kept flag, with the missing count of the whole feature table."""
    cols = [(g, c) for g, cs in GROUPS.items() for c in cs]
    wide = feature_rows(t).agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, (_, c) in enumerate(cols)])
    cells = ", ".join(f"'{g}', '{c}', {str(c in NUM or g == 'Categorical').lower()}, n{i}" for i, (g, c) in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {cells}) AS (feature_group, feature, kept, missing)")


# ---- moments and inference ----

GC = ["promised_lead_days", "order_item_count", "is_weekend_approval"]


@query("gram_matrix", " UNION ALL ".join(f"SELECT '{a}' AS left_col, '{b}' AS right_col, sum({a} * {b})::DOUBLE AS total, count(*) AS n FROM feat" for i, a in enumerate(GC) for b in GC[i:]))
def _(t):
    return stats.gram_table(feature_rows(t), GC)


V3 = ["promised_lead_days", "payment_value_sum", "order_frieght_value_sum"]


@query("vif", f"""WITH k AS (SELECT * FROM feat WHERE payment_value_sum IS NOT NULL), r AS (SELECT corr({V3[0]}, {V3[1]}) AS a, corr({V3[0]}, {V3[2]}) AS b, corr({V3[1]}, {V3[2]}) AS c FROM k), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
    SELECT '{V3[0]}' AS feature, round((1 - c * c) / det, 4) AS vif FROM d UNION ALL SELECT '{V3[1]}', round((1 - b * b) / det, 4) FROM d UNION ALL SELECT '{V3[2]}', round((1 - a * a) / det, 4) FROM d""", digits=4)
def _(t):
    return stats.vif_table(feature_rows(t).where("payment_value_sum IS NOT NULL"), V3)


def _design(t, task="classification"):
    rows = train_rows(t, task)
    d = design.fit_design(rows, NUM, CAT, log_cols=LOGS, cyclic=True, merge_mixed_route=True)
    return d, d.encode(rows, keep=["order_id", "y"])


@query("design_vif")
def _(t):
    d, x = _design(t)
    return stats.vif_table(x, d.columns)


ALL_NUM = features.numeric_cols(PAYMENT_TYPES)
REPRESENTATIVES = {"order_revenue_sum": "sum of price and freight", "seller_dist_km_min": "mean represents distance", "seller_dist_km_max": "mean represents distance",
                   "seller_dist_km_median": "mean represents distance", "order_approved_week_of_year": "month and day represent the calendar",
                   **{c: "payment total and combination represent payment" for c in features.payment_cols(PAYMENT_TYPES)}}


def _grams(t):
    out = {}
    for task in ("classification", "regression"):
        rows = train_rows(t, task)
        out[task] = stats.gram(design.fit_design(rows, ALL_NUM, [], scale=False).encode(rows), ALL_NUM)
    return out


@query("vif_elimination")
def _(t):
    _, trace = stats.vif_elimination(_grams(t), REPRESENTATIVES, ["payment_value_sum"])
    return rows_df(t, trace, stats.TRACE)


@query("vif_stage_summary")
def _(t):
    _, trace = stats.vif_elimination(_grams(t), REPRESENTATIVES, ["payment_value_sum"])
    return stats.stage_summary(rows_df(t, trace, stats.TRACE), len(ALL_NUM))


@query("design_rank")
def _(t):
    out = []
    for task in ("classification", "regression"):
        d, x = _design(t, task)
        g = stats.gram(x, d.columns)
        rank = stats.design_rank(g, d.columns, 1e-10)
        out.append({"task": task, "rows": int(g.n), "encoded_columns": len(d.columns), "centred_rank": rank, "full_rank": rank == len(d.columns)})
    return rows_df(t, out, "task string, rows int, encoded_columns int, centred_rank int, full_rank boolean")


FIT = "term string, coef double, se double, statistic double, p_value double, ci_low double, ci_high double"


@query("ols_inference")
def _(t):
    d, x = _design(t, "regression")
    return rows_df(t, stats.ols_inference(x, d.columns, "y"), FIT)


REGTR = f"""rt AS (SELECT date_diff('day', approved_at::DATE, estimated_at::DATE)::DOUBLE AS x, {target(RUN, 45)} AS y FROM r_orders WHERE {WINDOW} AND {target(RUN, 45)} IS NOT NULL),
    mo AS (SELECT avg(x) AS mx, var_pop(x) * count(*) AS sxx, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM rt),
    re AS (SELECT x, y, y - a - b * x AS e, x - mx AS c, 1.0 / n + (x - mx) * (x - mx) / sxx AS h, b, a, sxx, n FROM rt, mo)"""


@query("ols_inference_single", f"""WITH {REGTR} SELECT 'promised_lead_days' AS term, round(any_value(b), 6) AS coef, round(sqrt(sum(c * c * e * e / ((1 - h) * (1 - h)))) / any_value(sxx), 6) AS se FROM re""")
def _(t):
    rows = labels.training_window(features.promise_features(t.orders), RUN_DATE, "regression")
    fit = stats.ols_inference(rows.select("y", F.col("promised_lead_days").cast("double").alias("promised_lead_days")), ["promised_lead_days"], "y")
    return rows_df(t, [r for r in fit if r["term"] != "const"], "term string, coef double, se double")


@query("breusch_pagan", f"WITH {REGTR} SELECT round(count(*) * corr(e * e, x) * corr(e * e, x), 4) AS lm, 1::BIGINT AS df, count(*) AS n FROM re", digits=4)
def _(t):
    rows = labels.training_window(features.promise_features(t.orders), RUN_DATE, "regression")
    out = stats.breusch_pagan(rows.select("y", F.col("promised_lead_days").cast("double").alias("promised_lead_days")), ["promised_lead_days"], "y")
    return rows_df(t, [out], "lm double, df int, n int")


def _linear_fit(t):
    d, x = _design(t, "regression")
    fit = stats.ols_from_gram(stats.gram(x, [*d.columns, "y"]), d.columns, "y")
    return d, stats.fitted(x, fit, "y"), fit


@query("heteroscedasticity_groups")
def _(t):
    _, x, _ = _linear_fit(t)
    code = ordering.qcut_code("fitted", ordering.quantile_edges(x, "fitted", 5)) + 1
    return x.groupBy(code.alias("fitted_group")).agg(F.avg("fitted").alias("mean_fitted"), F.avg("residual").alias("residual_mean"), F.stddev_samp("residual").alias("residual_sd"), n_rows("orders"))


@query("partial_residual_bins")
def _(t):
    d, x, fit = _linear_fit(t)
    term = "promised_lead_days"
    coef = float(fit.coef[1 + fit.columns.index(term)])
    part = x.withColumn("partial", F.col("residual") + F.lit(coef) * F.col(term))
    code = ordering.qcut_code(term, ordering.quantile_edges(part, term, 20))
    bins = part.groupBy(code.alias("bin")).agg(F.avg(term).alias("x"), F.avg("partial").alias("partial"))
    shift = bins.agg(F.avg(F.col("partial") - F.lit(coef) * F.col("x"))).first()[0]
    return bins.withColumn("line", F.lit(coef) * F.col("x") + F.lit(shift))


@query("residual_diagnostics")
def _(t):
    """Mean residual by fitted bin, quartiles by route and top states, and normal quantile points."""
    from ..functions.tails import normal_ppf
    d, x, _ = _linear_fit(t)
    x = x.join(train_rows(t, "regression").select("order_id", *CAT), "order_id")
    code = ordering.qcut_code("fitted", ordering.quantile_edges(x, "fitted", 20))
    a = x.groupBy(code.cast("string").alias("segment")).agg(F.avg("fitted").alias("low"), F.avg("residual").alias("mid"), F.lit(None).cast("double").alias("high")).select(F.lit("fitted bin").alias("view"), "*")
    top = [r[0] for r in x.groupBy("customer_state").count().orderBy(F.desc("count"), "customer_state").limit(8).collect()]
    def box(df, c, view):
        return ordering.exact_quantiles(df.where(F.col(c).isNotNull()), [c], ["residual"], {"low": .25, "mid": .5, "high": .75}).select(F.lit(view).alias("view"), F.col(c).alias("segment"), "low", "mid", "high")
    points = [i / 20 for i in range(1, 20)]
    qs = ordering.quantile_values(x, "residual", points)
    qq = t.spark.createDataFrame([("normal quantile", str(p), normal_ppf(p), float(v), None) for p, v in zip(points, qs)], "view string, segment string, low double, mid double, high double")
    return union_all([a, box(x, "route_type", "route"), box(x.where(F.col("customer_state").isin(top)), "customer_state", "state"), qq])


@query("logit_inference")
def _(t):
    d, x = _design(t)
    rows, info = ml.logit_inference(x, d.columns, "y")
    return rows_df(t, [{**r, "quasi_separated": r["term"] in info["unstable"]} for r in rows], FIT + ", quasi_separated boolean")


COEF = "term string, unit string, kind string, coef double, p_value double, effect_type string, effect_per_sd double, per_unit_basis string, effect_per_unit double, effect_per_unit_low double, effect_per_unit_high double"


def _coefficients(t, task):
    d, x = _design(t, task)
    rows = stats.ols_inference(x, d.columns, "y") if task == "regression" else ml.logit_inference(x, d.columns, "y")[0]
    return stats.coefficient_rows(rows, d, odds=task == "classification")


@query("coefficient_table")
def _(t):
    return union_all([rows_df(t, _coefficients(t, k), COEF).select(F.lit(k).alias("task"), "*") for k in ("classification", "regression")])


@query("hypothesis_check")
def _(t):
    rows = stats.hypothesis_rows({"C1": _coefficients(t, "classification"), "R1": _coefficients(t, "regression")})
    return rows_df(t, rows, "hypothesis string, feature string, model string, expected_sign string, observed_sign string, verdict string, coef double, p_value double")


# ---- selection ----

def _fold_grams(t, units):
    """(train, validation, unit columns) cross-products per fold; one design per training fold."""
    num, cat = [u for u in units if u not in CAT], [u for u in units if u in CAT]
    rows = folds(t, "regression")

    def one(i):
        train, valid = ml.fold_parts(rows, i)
        d = design.fit_design(train, num, cat, log_cols=[c for c in LOGS if c in num], cyclic=True, merge_mixed_route=True)
        cols = [*d.columns, "y"]
        return stats.gram(d.encode(train, keep=["y"]), cols), stats.gram(d.encode(valid, keep=["y"]), cols), d.units
    return ml.in_parallel(one, range(1, 6))


PATH = "step int, added_unit string, n_units int, cv_mean double, cv_se double"


def _cv_path(t):
    return stats.forward_cv(_fold_grams(t, NUM + CAT), NUM + CAT, "y")


def _ic_path(t, criterion):
    d, x = _design(t, "regression")
    return stats.forward_ic(stats.gram(x, [*d.columns, "y"]), d.units, "y", criterion)


@query("forward_cv_stepwise")
def _(t):
    return stats.mark_one_se(rows_df(t, _cv_path(t), PATH), higher_is_better=False)


@query("forward_ic_stepwise")
def _(t):
    rows = [{"criterion": c, **r} for c in ("aic", "bic") for r in _ic_path(t, c)]
    return rows_df(t, rows, "criterion string, step int, added_unit string, k int, aic double, bic double")


def _lasso(t, penalties=100):
    """Penalty chosen by mean fold error over the whole path, then the units with a non-zero coefficient."""
    d, x = _design(t, "regression")
    whole = stats.gram(x, [*d.columns, "y"])
    grid = stats.lasso_penalties(whole, d.columns, "y", penalties)
    errors = []
    for train, valid, units in _fold_grams(t, NUM + CAT):
        names = [c for cols in units.values() for c in cols]
        errors.append([stats.lasso_error(train, valid, names, "y", b) for b in stats.lasso_path(train, names, "y", grid)])
    best = int(np.argmin(np.mean(errors, axis=0)))
    values = dict(zip(d.columns, stats.lasso_path(whole, d.columns, "y", grid[:best + 1])[-1]))
    return float(grid[best]), [(u, max((abs(float(values[c])) for c in cols), default=0.0)) for u, cols in d.units.items()]


@query("lasso_selection")
def _(t):
    penalty, units = _lasso(t)
    return rows_df(t, [{"unit": u, "penalty": penalty, "largest_coef": v, "selected": v > 0} for u, v in units], "unit string, penalty double, largest_coef double, selected boolean")


@query("selection_overlap")
def _(t):
    path = stats.mark_one_se(rows_df(t, _cv_path(t), PATH), higher_is_better=False)
    picked = {c: [r["added_unit"] for r in _ic_path(t, c) if r["step"]] for c in ("bic", "aic")}
    return stats.selection_overlap(NUM + CAT, path, {**picked, "lasso": [u for u, v in _lasso(t)[1] if v > 0]})


# ---- selection for the late label ----

WHOLE = 6  # the fold of all training rows, after the five of the plan


def _wide(rows):
    """(rows with the terms of the linear design as columns, null where missing; unit -> columns). Scales and fill-in values are each
    fold's own; the levels are those of all given rows, so that one unseen in a fold is a column without variation there."""
    d = design.Design(NUM, CAT, {"log_cols": LOGS, "cyclic": True}, scale=False)
    counts = design.category_counts(rows.replace(design.ROUTE_MERGES, subset=["route_type"]), CAT)
    units = {u: list(terms) for u, terms in d.units_without_levels().items()}
    held = design.expand(rows, NUM, LOGS, cyclic=True, merge_mixed_route=True)
    for c in CAT:
        reference = min(counts[c], key=lambda x: (-x[1], x[0]))[0]
        units[c] = [f"{c}_{v}" for v, _ in counts[c] if v != reference]
        held = held.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for v, _ in counts[c] if v != reference})
    return held, units


def _logit_rows(t):
    """(rows with each fold's preparation, columns, unit columns): every training row once, with the folds that it trains and validates."""
    plan = folds(t)
    roles = plan.groupBy("order_id").agg(F.min(F.when(F.col("role") == "train", F.col("fold"))).alias("lo"), F.count_if(F.col("role") == "train").alias("trains"),
                                         F.min(F.when(F.col("role") == "valid", F.col("fold"))).alias("valid"))
    wide, units = _wide(train_rows(t))
    columns = [c for cols in units.values() for c in cols]
    member = wide.join(roles, "order_id", "left").withColumn("lo", F.coalesce("lo", F.lit(WHOLE)))
    if member.where((F.col("lo") < WHOLE) & (F.col("trains") != WHOLE - F.col("lo"))).head(1):
        raise ValueError("a row that trains in a fold must train in all later ones")
    rows = written(t, "logit-rows", lambda: logit.raw_rows(member, columns, F.col("lo"), F.lit(WHOLE), F.col("valid"), F.col("y")))
    return logit.prepare(rows, len(columns), range(1, WHOLE + 1)), columns, units


def _logit_ic(t, criteria=("aic", "bic")):
    rows, columns, units = _logit_rows(t)
    return logit.forward_ic(rows, WHOLE, columns, units, criteria)


def _logit_cv(t):
    rows, columns, units = _logit_rows(t)
    return logit.forward_cv(rows, columns, units, range(1, 6))


def _logit_l1(t):
    rows, columns, units = _logit_rows(t)
    table, model = logit.l1_path(rows, WHOLE, columns, range(1, 6))
    largest = dict(zip(columns, np.abs(model.beta[1:])))
    return table, [(u, max((float(largest[c]) for c in cols), default=0.0)) for u, cols in units.items()]


@query("forward_ic_stepwise_late")
def _(t):
    """AIC and BIC paths of the logit on the late label."""
    paths, _log = _logit_ic(t)
    rows = [{"criterion": c, **r} for c, path in paths.items() for r in path]
    return rows_df(t, rows, "criterion string, step int, added_unit string, k int, aic double, bic double, method string")


@query("stepwise_retry_log")
def _(t):
    """Candidates of the logit paths with a singular information matrix, or left out as their fit did not converge."""
    return rows_df(t, _logit_ic(t)[1], "step int, unit string, method string, reason string")


LATE_PATH = "step int, added_unit string, n_units int, n_encoded_columns int, cv_mean double, cv_se double"


@query("forward_cv_stepwise_late")
def _(t):
    """Path of the logit by mean fold average precision."""
    return stats.mark_one_se(rows_df(t, _logit_cv(t), LATE_PATH), higher_is_better=True)


@query("l1_penalty_path")
def _(t):
    return rows_df(t, _logit_l1(t)[0], "inverse_penalty double, mean_ap double, best boolean")


@query("l1_selection_late")
def _(t):
    table, units = _logit_l1(t)
    penalty = next(r["inverse_penalty"] for r in table if r["best"])
    return rows_df(t, [{"unit": u, "inverse_penalty": penalty, "largest_coef": v, "selected": v > 0} for u, v in units],
                   "unit string, inverse_penalty double, largest_coef double, selected boolean")


@query("selection_overlap_late")
def _(t):
    path = stats.mark_one_se(rows_df(t, _logit_cv(t), LATE_PATH), higher_is_better=True)
    picked = {c: [r["added_unit"] for r in p if r["step"]] for c, p in _logit_ic(t)[0].items()}
    return stats.selection_overlap(NUM + CAT, path, {**picked, "lasso": [u for u, v in _logit_l1(t)[1] if v > 0]})


# ---- models ----

def _score_tables(t, spec):
    fitted = ml.fit(spec, train_rows(t, spec.task))
    keep = ["order_id", "y", "split", "promised_lead_days"]
    return fitted, fitted.score(task_rows(t, spec.task).where("split IS NOT NULL"), keep)


def _cls_table(scored):
    return metrics.classification_metrics(scored.withColumn("label", F.col("y").cast("int")), [c for c in ("model", "split") if c in scored.columns])


@query("logistic_model")
def _(t):
    fitted, info = ml.logistic_checked(logit_spec(), train_rows(t))
    scored = fitted.score(task_rows(t).where("split IS NOT NULL"), ["order_id", "y", "split"])
    return _cls_table(scored).withColumn("converged", F.lit(info["converged"]))


@query("linear_model")
def _(t):
    _, scored = _score_tables(t, linear_spec())
    return metrics.regression_metrics(scored.withColumn("target", F.col("y")), ["split"])


@query("cv_metrics")
def _(t):
    return ml.cv_metrics([logit_spec("C1", NUM), tree_spec("classification", "C4", NUM, **TREE)], folds(t), 5)


@query("cv_metrics_regression")
def _(t):
    return ml.cv_metrics([linear_spec("R1", NUM)], folds(t, "regression"), 5)


SEARCH = "maxDepth int, minInstancesPerNode int, impurity string, mean_score double, sd_score double, n_leaves int, best boolean"


def _tree_grid(t, task):
    """All candidates of the tree search, written once and read by every query that needs them."""
    space = {**ml.TREE_SPACE, "impurity": ml.TREE_SPACE["impurity"] if task == "classification" else ["variance"]}
    found = lambda: trees.grid_search(lambda **p: tree_spec(task, **p), space, train_rows(t, task), folds(t, task), 5, task)
    return written(t, f"tree-grid-{task}", lambda: rows_df(t, found(), SEARCH))


@query("decision_tree_grid")
def _(t):
    return _tree_grid(t, "classification")


@query("decision_tree_grid_regression")
def _(t):
    return _tree_grid(t, "regression")


FOREST_ROW = "maxDepth int, minInstancesPerNode int, featureSubsetStrategy string, subsamplingRate double, impurity string, weight string, numTrees int"


def _forest_search(t, task, space=ml.FOREST_SPACE, tries=STAGE_A, first_trees=STAGE_A_TREES, second_trees=STAGE_B_TREES):
    """Random stage, then the neighbouring grid of its best candidate. Both stages share one table of scores, kept for the session."""
    if task == "regression":
        space = {**{k: v for k, v in space.items() if k != "weight"}, "impurity": ["variance"]}
    fs, spec = folds(t, task), lambda c: forest_spec(task, **c)
    key = (t.spark.sparkContext.applicationId, t.path, f"forest-search-{task}-{tries}-{first_trees}")
    path = _WRITTEN.setdefault(key, shared_path(t.spark, "forest-search"))

    def stage(name, candidates):
        found = ml.candidate_table(ml.search(spec, candidates, fs, 5, path), FOREST_ROW)
        return ml.mark_best(found, [F.col("maxDepth"), F.desc("minInstancesPerNode"), F.col("numTrees")]).select(F.lit(name).alias("stage"), "*")
    first = stage("A", [{**c, "numTrees": first_trees} for c in ml.random_grid(space, tries)])
    best = first.where("best").first().asDict()
    second = stage("B", ml.neighbour_grid(space, {k: best[k] for k in space}, ["maxDepth", "minInstancesPerNode", "featureSubsetStrategy"], numTrees=list(second_trees)))
    return first.withColumn("best", F.lit(False)).unionByName(second)


@query("random_forest_search")
def _(t):
    return _forest_search(t, "classification")


@query("random_forest_search_regression")
def _(t):
    return _forest_search(t, "regression")


@query("hyperparameter_sensitivity")
def _(t):
    return metrics.hyperparameter_sensitivity(_tree_grid(t, "classification"), ["maxDepth", "minInstancesPerNode", "impurity"])


@query("gbt_model")
def _(t):
    spec = ml.Spec("GBT", "classification", lambda: ml.gbt("classification", **BOOST), NUM, CAT, weight="balanced")
    return _cls_table(_score_tables(t, spec)[1])


@query("baselines", f"""WITH {TASK}, p AS (SELECT avg(y) AS prior, quantile_cont({target(RUN, 45)}, 0.5) AS med FROM task WHERE split = 'train')
    SELECT order_id, round(prior, 6) AS prior_rate, med::DOUBLE AS median_days, greatest(least(0, 45 - date_diff('day', approved_at::DATE, estimated_at::DATE)), -date_diff('day', approved_at::DATE, estimated_at::DATE))::DOUBLE AS promise_days FROM task, p WHERE split = 'test' AND strftime(approved_at, '%Y-%m') >= '1995-02'""")
def _(t):
    from ..functions.scalars import clip_to_waiting_period
    prior, med = train_rows(t).agg(F.avg("y"), F.median("target")).first()
    zero = clip_to_waiting_period(F.lit(0.0), "promised_lead_days", 45)
    return test_rows(t).select("order_id", F.lit(prior).alias("prior_rate"), F.lit(float(med)).alias("median_days"), zero.cast("double").alias("promise_days"))


@query("out_of_fold_scores")
def _(t):
    return ml.out_of_fold(logit_spec("C1", NUM), folds(t), train_rows(t), 5)


@query("refit_check")
def _(t):
    """Both tasks: the same specification fitted on Train and on the whole history, scored on every later month of the data."""
    last = t.orders.agg(F.max(day("approved_at"))).first()[0]
    later = labels.scoring_eligibility(feature_rows(t), RUN_DATE, last).where(~F.col("order_status").isin(labels.EXCLUDED_STATUSES)).withColumn("month", month_label("approved_at"))
    known = F.date_add(day("approved_at"), 46)
    late = labels.labels_as_of(later, known).withColumn("y", F.col("label").cast("double"))
    lead = labels.targets_as_of(later, known, 45).withColumn("y", F.col("target").cast("double"))
    parts = {}
    for spec, rows, truth in ((logit_spec("C1"), late, "label"), (linear_spec("R1"), lead, "target")):
        fits = (("train", train_rows(t, spec.task)), ("history", task_rows(t, spec.task)))
        parts[spec.task] = union_all([ml.fit(spec, part).score(rows, ["order_id", "month", truth, "promised_lead_days"]).withColumn("model", F.lit(name)) for name, part in fits])
    tables = [metrics.classification_metrics(parts["classification"], ["model", "month"]), metrics.regression_metrics(parts["regression"], ["model", "month"])]
    long = [x.select(F.lit(k).alias("task"), "model", "month", F.explode(F.create_map(*[v for c in x.columns if c not in ("model", "month") for v in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))
            for k, x in zip(("classification", "regression"), tables)]
    both = union_all(long).groupBy("task", "month", "metric").agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in ("train", "history")])
    return both.withColumn("history_minus_train", F.col("history") - F.col("train"))


@query("feature_group_ablation")
def _(t):
    """One model per feature group on the same rows, by month of the validation block and averaged."""
    from ..operators import history
    hist = written(t, "entity-history", lambda: history.smoothed_entity_history(t.orders, t.items, "seller_id", "seller")
                   .join(history.smoothed_entity_history(t.orders, t.items, "product_id", "product"), "order_id"))
    train, test = (rows.join(hist, "order_id") for rows in (train_rows(t), test_rows(t)))
    s, p = ["seller_late_rate_mean", "seller_no_history_share"], ["product_late_rate_mean", "product_no_history_share"]
    groups = {"base": NUM, "base + seller": NUM + s, "base + product": NUM + p, "both": NUM + s + p}
    parts = [ml.fit(logit_spec(g, cols, []), train).score(test, ["order_id", "month", "y"]).withColumn("model", F.lit(g)) for g, cols in groups.items()]
    by = metrics.classification_metrics(union_all(parts).withColumn("label", F.col("y").cast("int")), ["model", "month"]).select("model", "month", "avg_precision", "roc_auc")
    mean = by.groupBy("model").agg(F.avg("avg_precision").alias("avg_precision"), F.avg("roc_auc").alias("roc_auc")).select("model", F.lit("equal-month mean").alias("month"), "avg_precision", "roc_auc")
    return by.unionByName(mean)


@query("monthly_backtest")
def _(t):
    """Refit at the start of each month whose training window lies in the data and score that month: metrics per month, their equal-weight
    mean and deviation, and the metrics of all months together. All refits share their passes over the rows, which are stored once."""
    rows = feature_rows(t)
    months = backtest_months(rows)
    scored = ml.monthly_refits(_wide, rows, months).withColumn("month", F.element_at(F.array(*[F.lit(m) for m in months]), F.col("model") + 1))
    cols = ["avg_precision", "roc_auc", "brier"]
    table = metrics.classification_metrics(scored, ["month"]).select("month", *cols)
    summary = [table.agg(*[fn(c).alias(c) for c in cols]).select(F.lit(name).alias("month"), *cols)
               for name, fn in (("equal-weight mean", F.avg), ("equal-weight sd", F.stddev_samp))]
    return union_all([table, *summary, metrics.classification_metrics(scored).select(F.lit("pooled").alias("month"), *cols)])


def backtest_months(rows) -> list[str]:
    """Months with approvals whose whole training window lies after the first approval; bounded by the calendar."""
    found = rows.where("approved_at IS NOT NULL").groupBy(month_label("approved_at").alias("month")).agg(F.min(day("approved_at")).alias("first")).orderBy("month").collect()
    return [r["month"] for r in found if labels.required_dates(f"{r['month']}-02", 45, 365)[0] >= found[0]["first"]]


@query("class_weight_sensitivity")
def _(t):
    parts = []
    for name, w in (("unweighted", None), ("balanced", "balanced")):
        parts.append(_score_tables(t, logit_spec(name, NUM, weight=w))[1].withColumn("model", F.lit(name)))
    return _cls_table(union_all(parts))


BALANCE = f"WITH {TASK}, c AS (SELECT y::DOUBLE AS y, count(*) AS n FROM task WHERE split = 'train' AND strftime(approved_at, '%Y-%m') >= '1995-02' GROUP BY 1)"


@query("resample_under", f"{BALANCE} SELECT y, (SELECT min(n) FROM c) AS rows, (SELECT min(n) FROM c) AS orders FROM c")
def _(t):
    return ml.undersample(train_rows(t)).groupBy("y").agg(n_rows("rows"), F.count_distinct("order_id").alias("orders"))


@query("resample_over", f"{BALANCE} SELECT y, (SELECT max(n) FROM c) AS rows, n AS orders FROM c")
def _(t):
    return ml.oversample(train_rows(t)).groupBy("y").agg(n_rows("rows"), F.count_distinct("order_id").alias("orders"))


@query("resample_smotenc")
def _(t):
    made = ml.synthetic_minority(train_rows(t), NUM, CAT)
    return made.groupBy("y").agg(n_rows("rows"), F.count_if(F.col("order_id") < 0).alias("synthetic"), *[F.avg(c).alias(f"mean_{c}") for c in NUM])


@query("resampling_experiment")
def _(t):
    """The logit and the forest under every strategy: five folds, and one fit on all training rows scored on Validation."""
    plan, specs = folds(t), [logit_spec("C1"), forest_spec("classification", "C3", weight="balanced")]
    def one(job):
        strategy, fold = job
        train, valid = ml.fold_parts(plan, fold) if fold else (train_rows(t), test_rows(t))
        return ml.resampled_scores(specs, train, valid, NUM, CAT, strategy, fold)
    return ml.resampling_summary(union_all(ml.in_parallel(one, [(s, i) for s in ml.STRATEGIES for i in range(6)])))


# ---- interpretation ----

def _forest(t):
    return ml.fit(forest_spec("classification", weight="balanced"), train_rows(t))


def _importance(t):
    return ml.permutation_importance(_forest(t), test_rows(t), NUM + CAT, repeats=REPEATS)


@query("permutation_importance")
def _(t):
    return _importance(t)


@query("feature_rank")
def _(t):
    table = rows_df(t, [{"feature": f, "importance": v} for f, v in ml.impurity_importance(_forest(t))], "feature string, importance double")
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # one row per feature


@query("impurity_importance")
def _(t):
    both = [(k, ml.fit(tree_spec("classification", k, **TREE) if k == "tree" else forest_spec("classification", k, weight="balanced"), train_rows(t))) for k in ("tree", "forest")]
    return rows_df(t, [{"model": k, "feature": f, "importance": v} for k, m in both for f, v in ml.impurity_importance(m)], "model string, feature string, importance double")


ASKED = 5  # numeric predictors whose dependence is reported, by importance


@query("partial_dependence")
def _(t):
    """The most important numeric predictors over 20 points and both categoricals over their levels."""
    f, rows = _forest(t), train_rows(t)
    top = [c for c, _ in ml.impurity_importance(f) if c in NUM][:ASKED]
    return ml.partial_dependence(f, rows, ml.dependence_grids(rows, top, CAT))


@query("linear_importance")
def _(t):
    table = rows_df(t, _coefficients(t, "classification"), COEF).where("kind <> 'intercept'").withColumn("importance", F.abs("coef"))
    top = table.groupBy("unit").agg(F.max_by(F.struct("term", "kind", "coef", "importance"), "importance").alias("r")).select("unit", "r.*")
    return top.withColumn("odds_ratio", F.exp("coef")).withColumn("direction", F.when(F.col("coef") > 0, "raises late risk").otherwise("lowers late risk"))


@query("model_agreement")
def _(t):
    """Top features of the forest beside the smallest p-value of the same feature in the logit."""
    p = rows_df(t, _coefficients(t, "classification"), COEF).where("kind <> 'intercept'").groupBy("unit").agg(F.min("p_value").alias("linear_min_p"))
    return _importance(t).where("rank <= 10").join(p, F.col("feature") == F.col("unit"), "left").select(
        "rank", "feature", "importance_mean", "linear_min_p", (F.col("linear_min_p") < 0.05).alias("linear_significant"))


@query("model_size")
def _(t):
    fits = {"linear": ml.fit(logit_spec("l", NUM), train_rows(t)), "tree": ml.fit(tree_spec("classification", "t", **TREE), train_rows(t)), "forest": _forest(t)}
    return rows_df(t, [{"family": k, "parameters": ml.model_size(v.model)} for k, v in fits.items()], "family string, parameters int")


@query("bulk_score", """SELECT CASE WHEN order_id % 50 = 1 THEN 'order_item_count: count' ELSE '' END AS violations, count(*) AS rows,
    count(*) FILTER (WHERE order_id % 50 <> 1) AS scored FROM feat GROUP BY 1""")
def _(t):
    f = ml.fit(logit_spec("C1", NUM), train_rows(t))
    rows = feature_rows(t).withColumn("order_item_count", F.when(F.col("order_id") % 50 == 1, 0).otherwise(F.col("order_item_count")))
    states = f.design.levels["customer_state"]
    # The model reads all predictors; the rules checked are those of the columns that the SQL states.
    out = ml.bulk_score(f, rows, ["promised_lead_days", "seller_dist_km_mean", "payment_value_sum", "order_item_count"], {"customer_state": states},
                        others=feature_rows(t).columns)
    return out.groupBy(F.array_join("violations", ",").alias("violations")).agg(n_rows("rows"), F.count("p").alias("scored"))
