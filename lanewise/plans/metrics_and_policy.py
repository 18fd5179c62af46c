"""Metrics over scored rows, result tables, model choice, worklist and replay."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.nulls import n_rows
from ..functions.times import day
from ..operators import comparison, cubes, labels, metrics, ordering, policy
from ..operators.audits import union_all
from .catalog import query
from .oracle import CUTOFF, label, target

# A second, deliberately different score of the same orders, and named periods.
SQL_LONG = """sl AS (SELECT * FROM (SELECT s.*, CASE WHEN month BETWEEN '1997-01' AND '1998-03' THEN 'Train' WHEN month BETWEEN '1998-04' AND '1998-05' THEN 'Validation'
    WHEN month = '1998-06' THEN 'June' WHEN month = '1998-07' THEN 'July' WHEN month = '1998-08' THEN 'August' END AS split,
    model, CASE model WHEN 'M1' THEN p WHEN 'M2' THEN ((s.order_id * 6007 + 13) % 499) / 499.0::DOUBLE ELSE 0.1::DOUBLE END AS sc,
    CASE model WHEN 'M1' THEN days WHEN 'M2' THEN (s.order_id % 31 - 15)::DOUBLE ELSE 0.0::DOUBLE END AS dy
    FROM scored s, (VALUES ('M1'), ('M2'), ('M0')) v(model)) WHERE split IS NOT NULL)"""


def long_scores(t):
    month = F.col("month")
    split = F.when(month.between("1997-01", "1998-03"), "Train").when(month.between("1998-04", "1998-05"), "Validation") \
        .when(month == "1998-06", "June").when(month == "1998-07", "July").when(month == "1998-08", "August")
    parts = F.array(
        F.struct(F.lit("M1").alias("model"), F.col("p").alias("sc"), F.col("days").alias("dy")),
        F.struct(F.lit("M2").alias("model"), (((F.col("order_id") * 6007 + 13) % 499) / F.lit(499.0)).alias("sc"), (F.col("order_id") % 31 - 15).cast("double").alias("dy")),
        F.struct(F.lit("M0").alias("model"), F.lit(0.1).alias("sc"), F.lit(0.0).alias("dy")))
    return t.scored.withColumn("split", split).where("split IS NOT NULL").withColumn("_m", F.explode(parts)).select(
        "order_id", "approval_day", "month", "split", "customer_state", "promised_lead_days", "label", "target", "_m.model",
        F.col("_m.sc").alias("p"), F.col("_m.dy").alias("days"))


def _cls_sql(src, by, score, lab):
    keys = ", ".join(by)
    part = f"PARTITION BY {keys}" if by else ""
    grp = f"GROUP BY {keys}" if by else ""
    using = f"JOIN tp USING ({keys})" if by else ", tp"
    k0 = keys + ", " if by else ""
    return f"""c AS (SELECT {k0}{score} AS score, count({lab}) AS k, coalesce(sum({lab}), 0) AS pos FROM {src} WHERE {score} IS NOT NULL GROUP BY {k0}{score}),
    w AS (SELECT *, sum(k) OVER q AS ck, sum(pos) OVER q AS cp FROM c WINDOW q AS ({part} ORDER BY score DESC)),
    m AS (SELECT {k0}sum(k)::BIGINT AS n_known, sum(pos)::BIGINT AS n_late, sum(CASE WHEN pos > 0 THEN pos * cp / ck::DOUBLE END) AS ap,
      sum((k - pos) * (cp - pos + pos / 2.0::DOUBLE)) AS auc, sum(pos * (score - 1) * (score - 1) + (k - pos) * score * score) AS loss,
      coalesce(sum(pos) FILTER (WHERE score >= 0.5), 0) AS t5, coalesce(sum(k) FILTER (WHERE score >= 0.5), 0) AS f5 FROM w {grp}),
    rk AS (SELECT {k0}{lab} AS y, row_number() OVER ({part} ORDER BY {score} DESC, order_id) AS r, count(*) OVER ({part}) AS n FROM {src} WHERE {score} IS NOT NULL),
    tp AS (SELECT {k0}any_value(n) AS n_scored, count(*) AS tc, coalesce(sum(y), 0) AS tl FROM rk WHERE r <= greatest(1, ceil(n * 0.1::DOUBLE)) {grp}),
    cls AS (SELECT {k0}n_scored, n_known, n_late, n_late / n_known::DOUBLE AS late_rate, CASE WHEN n_late > 0 AND n_late < n_known THEN ap / n_late END AS avg_precision,
      CASE WHEN n_late > 0 AND n_late < n_known THEN auc / (n_late * (n_known - n_late)) END AS roc_auc, loss / n_known AS brier, coalesce(t5 / nullif(f5, 0)::DOUBLE, 0) AS precision_at_0_5,
      coalesce(t5 / nullif(n_late, 0)::DOUBLE, 0) AS recall_at_0_5, coalesce(2 * t5 / nullif(f5 + n_late, 0)::DOUBLE, 0) AS f1_at_0_5, tl / tc::DOUBLE AS precision_top10, tl / nullif(n_late, 0)::DOUBLE AS recall_top10,
      CASE WHEN n_late > 0 THEN coalesce(2 * tl / nullif(tc + n_late, 0)::DOUBLE, 0) ELSE 0 END AS f1_top10, (tl / nullif(n_late, 0)::DOUBLE) / (tc / n_scored::DOUBLE) AS top10_lift FROM m {using})"""


CLS_COLS = ["late_rate", "avg_precision", "roc_auc", "brier", "precision_at_0_5", "recall_at_0_5", "f1_at_0_5", "precision_top10", "recall_top10", "f1_top10", "top10_lift"]
ROUND_CLS = ", ".join(f"round({c}, 6) AS {c}" for c in CLS_COLS)


@query("classification_metrics", f"WITH {_cls_sql('scored', ['month'], 'p', 'label')} SELECT month, n_scored, n_known, n_late, {ROUND_CLS} FROM cls")
def _(t):
    return metrics.classification_metrics(t.scored, ["month"])


@query("classification_metrics_global", f"WITH {_cls_sql('scored', [], 'p', 'label')} SELECT n_scored, n_known, n_late, {ROUND_CLS} FROM cls")
def _(t):
    return metrics.classification_metrics(t.scored)


@query("binary_metric_check", f"""WITH docs AS (SELECT doc_id AS order_id, quality AS label, n_chars::DOUBLE / 100000 AS score FROM labels JOIN documents USING (doc_id)),
    {_cls_sql('docs', [], 'score', 'label')} SELECT n_scored, n_known, n_late, {ROUND_CLS} FROM cls""")
def _(t):
    return metrics.classification_metrics(t.doc_scores.withColumn("p", F.col("score") / 100000))


def _reg_sql(src, by, actual, pred):
    keys = ", ".join(by)
    return f"""reg AS (SELECT {keys}, count(*) AS n, avg(abs({pred} - {actual})) AS mae, sqrt(avg(({pred} - {actual}) * ({pred} - {actual}))) AS rmse,
      1 - sum(({pred} - {actual}) * ({pred} - {actual})) / nullif(count(*) * var_pop({actual}), 0) AS r2, avg({pred} - {actual}) AS bias, quantile_cont(abs({pred} - {actual}), 0.5) AS median_ae
      FROM {src} WHERE {actual} IS NOT NULL AND {pred} IS NOT NULL GROUP BY {keys})"""


REG_COLS = ["mae", "rmse", "r2", "bias", "median_ae"]


@query("regression_metrics", f"WITH {_reg_sql('scored', ['month'], 'target', 'days')} SELECT month, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in REG_COLS) + " FROM reg")
def _(t):
    return metrics.regression_metrics(t.scored, ["month"])


SPLIT_SQL = f"""{SQL_LONG}, {_reg_sql('sl', ['model', 'split'], 'target', 'dy')}, ex AS (SELECT model, split, sqrt(avg((dy - target) ** 2) FILTER (WHERE label = 1)) AS rmse_late,
    avg(abs(dy - target)) FILTER (WHERE label = 1) AS mae_late, sqrt(avg((dy - target) ** 2) FILTER (WHERE label = 0)) AS rmse_on_time, avg(abs(dy - target)) FILTER (WHERE label = 0) AS mae_on_time,
    count(*) FILTER (WHERE label = 1 AND dy > 0 AND target IS NOT NULL) AS tp, count(*) FILTER (WHERE label IS NOT NULL AND dy > 0 AND target IS NOT NULL) AS f, count(*) FILTER (WHERE label = 1 AND target IS NOT NULL) AS n_actual_late,
    count(*) FILTER (WHERE target IS NULL) AS n_unknown FROM sl GROUP BY 1, 2),
    rs AS (SELECT reg.*, ex.* EXCLUDE (model, split, tp, f), coalesce(tp / nullif(f, 0)::DOUBLE, 0) AS late_flag_precision, coalesce(tp / nullif(n_actual_late, 0)::DOUBLE, 0) AS late_flag_recall,
    coalesce(2 * tp / nullif(f + n_actual_late, 0)::DOUBLE, 0) AS late_flag_f1 FROM reg JOIN ex USING (model, split))"""
EXTRA = ["rmse_late", "mae_late", "rmse_on_time", "mae_on_time", "late_flag_precision", "late_flag_recall", "late_flag_f1"]


def _reg_results(t):
    return metrics.regression_split_metrics(long_scores(t), ["model", "split"], late="label")


@query("regression_split_metrics", f"WITH {SPLIT_SQL} SELECT model, split, n, n_actual_late, n_unknown, " + ", ".join(f"round({c}, 6) AS {c}" for c in REG_COLS + EXTRA) + " FROM rs")
def _(t):
    return _reg_results(t)


@query("score_months", f"""SELECT month, count(*) AS scored, count(label) AS known, coalesce(sum(label), 0)::BIGINT AS late, round(avg(p), 6) AS mean_score FROM scored WHERE month BETWEEN '1998-06' AND '1998-08' GROUP BY 1""")
def _(t):
    """Eligibility, score and label of each month's daily cohorts, pooled per month."""
    rows = labels.scoring_eligibility(t.orders, "1998-06-01", "1998-08-31").where(~F.col("order_status").isin(labels.EXCLUDED_STATUSES))
    daily = rows.select("order_id", F.date_format(day("approved_at"), "yyyy-MM").alias("month")).join(t.scores.where("p IS NOT NULL"), "order_id")
    return labels.attach_prediction_labels(daily, t.orders, 45).groupBy("month").agg(
        n_rows("scored"), F.count("actual_label").alias("known"), F.coalesce(F.sum("actual_label"), F.lit(0)).alias("late"), F.avg("p").alias("mean_score"))


CLS_LONG = f"{SQL_LONG}, {_cls_sql('sl', ['model', 'split'], 'sc', 'label')}"

def _cls_results(t):
    return metrics.classification_metrics(long_scores(t), ["model", "split"])


def _fold_rows(t):
    m = F.col("month")
    return long_scores(t).where("split = 'Train'").withColumn(
        "fold", F.when(m <= "1997-03", 1).when(m <= "1997-06", 2).when(m <= "1997-09", 3).when(m <= "1997-12", 4).otherwise(5))


def _cls_folds(t):
    return metrics.classification_metrics(_fold_rows(t), ["model", "fold"])


# Two metric tables in one statement: fold-level ones keep their own names.
FOLD_CLS = (SQL_LONG.replace("sl AS", "fsrc AS") + ", fl AS (SELECT *, CASE WHEN month <= '1997-03' THEN 1 WHEN month <= '1997-06' THEN 2 WHEN month <= '1997-09' THEN 3 "
            "WHEN month <= '1997-12' THEN 4 ELSE 5 END AS fold FROM fsrc WHERE split = 'Train'), " + _cls_sql("fl", ["model", "fold"], "sc", "label")
            .replace("c AS (", "fc AS (", 1).replace("FROM c ", "FROM fc ").replace("w AS (", "fw AS (", 1).replace("FROM w ", "FROM fw ")
            .replace("m AS (SELECT", "fm AS (SELECT", 1).replace("rk AS (", "frk AS (").replace("FROM rk ", "FROM frk ").replace("tp AS (", "ftp AS (")
            .replace("JOIN tp ", "JOIN ftp ").replace("FROM m JOIN", "FROM fm JOIN").replace("cls AS (", "fcls AS ("))


@query("cv_mean_sd", f"""WITH {FOLD_CLS} SELECT model, round(avg(avg_precision), 6) AS avg_precision_mean, round(stddev_samp(avg_precision), 6) AS avg_precision_sd,
    round(avg(roc_auc), 6) AS roc_auc_mean, round(stddev_samp(roc_auc), 6) AS roc_auc_sd FROM fcls GROUP BY 1""")
def _(t):
    return metrics.cv_mean_sd(_cls_folds(t), ["avg_precision", "roc_auc"])


SPLITS = ["Train", "Validation", "June", "July", "August"]


@query("comparison_table", f"WITH {CLS_LONG}, {FOLD_CLS}, cv AS (SELECT model, avg(avg_precision) AS a, stddev_samp(avg_precision) AS s FROM fcls GROUP BY 1) SELECT model, " + ", ".join(
    f"round(100 * max(avg_precision) FILTER (WHERE split = '{s}'), 4) AS \"{s}\"" for s in SPLITS) + ", round(100 * max(a), 4) AS cv_mean, round(100 * max(s), 4) AS cv_sd FROM cls JOIN cv USING (model) GROUP BY model", digits=4)
def _(t):
    return metrics.comparison_table(_cls_results(t), _cls_folds(t), "avg_precision", SPLITS, 100.0)


@query("overfitting_gaps", f"WITH {CLS_LONG}, {FOLD_CLS} SELECT c.model, round(any_value(c.avg_precision) - avg(f.avg_precision), 6) AS avg_precision, round(any_value(c.brier) - avg(f.brier), 6) AS brier FROM cls c JOIN fcls f ON c.model = f.model WHERE c.split = 'Train' GROUP BY 1")
def _(t):
    return metrics.overfitting_gaps(_cls_results(t), _cls_folds(t), ["avg_precision", "brier"])


@query("tuning_gain", f"""WITH {CLS_LONG}, {FOLD_CLS}, r AS (SELECT model, split, avg_precision, brier FROM cls WHERE split IN ('Validation', 'June') UNION ALL SELECT model, 'CV', avg(avg_precision), avg(brier) FROM fcls GROUP BY 1),
    l AS (SELECT * FROM r UNPIVOT (value FOR metric IN (avg_precision, brier))) SELECT metric, split, round(max(value) FILTER (WHERE model = 'M1'), 6) AS tuned, round(max(value) FILTER (WHERE model = 'M2'), 6) AS baseline,
    round(max(value) FILTER (WHERE model = 'M1') - max(value) FILTER (WHERE model = 'M2'), 6) AS gain FROM l GROUP BY 1, 2""")
def _(t):
    return metrics.tuning_gain(_cls_results(t), _cls_folds(t), "M1", "M2", ["avg_precision", "brier"], ["Validation", "June"])


def _split_sql(cols):
    return "SELECT model, " + ", ".join(f"round(max({c}) FILTER (WHERE split = '{s}'), 6) AS \"{s}_{c}\"" for s in ("Validation", "June") for c in cols)


@query("error_split_table", f"WITH {SPLIT_SQL} {_split_sql(['rmse_late', 'mae_late', 'rmse_on_time', 'mae_on_time'])} FROM rs GROUP BY 1")
def _(t):
    return metrics.split_table(_reg_results(t), ["rmse_late", "mae_late", "rmse_on_time", "mae_on_time"], ["Validation", "June"])


@query("late_flag_table", f"WITH {SPLIT_SQL} {_split_sql(['late_flag_precision', 'late_flag_recall', 'late_flag_f1'])} FROM rs GROUP BY 1")
def _(t):
    return metrics.split_table(_reg_results(t), ["late_flag_precision", "late_flag_recall", "late_flag_f1"], ["Validation", "June"])


@query("dual_framing", f"""WITH {SPLIT_SQL}, {_cls_sql('sl', ['model', 'split'], 'sc', 'label')} SELECT 'classifier' AS framing, model, split, round(precision_at_0_5, 6) AS precision, round(recall_at_0_5, 6) AS recall, round(f1_at_0_5, 6) AS f1 FROM cls
    UNION ALL SELECT 'days flag', model, split, round(late_flag_precision, 6), round(late_flag_recall, 6), round(late_flag_f1, 6) FROM rs""")
def _(t):
    names = ["precision", "recall", "f1"]
    a = _cls_results(t).select(F.lit("classifier").alias("framing"), "model", "split", *[F.col(f"{n}_at_0_5").alias(n) for n in names])
    b = _reg_results(t).select(F.lit("days flag").alias("framing"), "model", "split", *[F.col(f"late_flag_{n}").alias(n) for n in names])
    return a.unionByName(b)


@query("drift_table", f"""WITH {CLS_LONG}, l AS (SELECT * FROM (SELECT model, split, avg_precision, late_rate FROM cls) UNPIVOT (value FOR metric IN (avg_precision, late_rate))) SELECT model, metric, round(max(value) FILTER (WHERE split = 'June'), 6) AS "June",
    round(max(value) FILTER (WHERE split = 'July'), 6) AS "July", round(max(value) FILTER (WHERE split = 'August'), 6) AS "August", round(max(value) FILTER (WHERE split = 'August') - max(value) FILTER (WHERE split = 'June'), 6) AS change FROM l GROUP BY 1, 2""")
def _(t):
    return metrics.drift_table(_cls_results(t), ["avg_precision", "late_rate"], ["June", "July", "August"])


@query("success_criteria_cls", f"""WITH {CLS_LONG}, r AS (SELECT split, model, 'AP against no-skill' AS criterion, avg_precision / b AS value, 2.0::DOUBLE AS threshold FROM cls JOIN (SELECT split, avg_precision AS b FROM cls WHERE model = 'M0') USING (split) WHERE model <> 'M0'
    UNION ALL SELECT split, model, 'top-10% precision against best linear', precision_top10, 1.1::DOUBLE * p FROM cls JOIN (SELECT split, max(precision_top10) AS p FROM cls WHERE model = 'M2' GROUP BY 1) USING (split) WHERE model = 'M1')
    SELECT split, model, criterion, round(value, 6) AS value, round(threshold, 6) AS threshold, coalesce(value >= threshold, false) AS passed FROM r""")
def _(t):
    return metrics.success_classification(_cls_results(t), "M0", ["M2"], ["M1"])


@query("success_criteria_reg", f"""WITH {SPLIT_SQL} SELECT a.split, a.model, 'RMSE below M0' AS criterion, round(1 - a.rmse / b.rmse, 6) AS value, 0.1::DOUBLE AS threshold, 1 - a.rmse / b.rmse >= 0.1 AS passed FROM rs a JOIN rs b ON a.split = b.split AND b.model = 'M0' WHERE a.model <> 'M0'
    UNION ALL SELECT a.split, a.model, 'gain over best linear (reported)', round(1 - a.rmse / b.rmse, 6), NULL, NULL FROM rs a JOIN rs b ON a.split = b.split AND b.model = 'M2' WHERE a.model = 'M1'""")
def _(t):
    return metrics.success_regression(_reg_results(t), {"M0": 0.1}, ["M2"], ["M1"])


CURVE = "cv0 AS (SELECT p AS score, count(label) AS k, coalesce(sum(label), 0) AS pos, count(*) AS n FROM scored GROUP BY 1), cv AS (SELECT *, sum(k) OVER q AS ck, sum(pos) OVER q AS cp, sum(k) OVER () AS ak, sum(pos) OVER () AS ap FROM cv0 WINDOW q AS (ORDER BY score DESC))"


@query("f1_threshold", f"WITH {CURVE}, f AS (SELECT score, 2 * cp / (ck + ap)::DOUBLE AS f1 FROM cv WHERE k > 0) SELECT round(min(score) FILTER (WHERE f1 = m), 6) AS threshold, round(any_value(m), 6) AS f1 FROM f, (SELECT max(f1) AS m FROM f)")
def _(t):
    return metrics.f1_threshold(metrics.score_curve(t.scored))


@query("confusion_at", " UNION ALL ".join(f"""SELECT {c}::DOUBLE AS threshold, count(*) FILTER (WHERE p >= {c}::DOUBLE AND label = 1) AS true_positive, count(*) FILTER (WHERE p >= {c}::DOUBLE AND label = 0) AS false_positive,
    count(*) FILTER (WHERE p < {c}::DOUBLE AND label = 1) AS false_negative, count(*) FILTER (WHERE p < {c}::DOUBLE AND label = 0) AS true_negative, round(100.0 * avg((p >= {c}::DOUBLE)::INTEGER), 6) AS flagged_pct,
    round(count(*) FILTER (WHERE p >= {c}::DOUBLE AND label = 1) / count(*) FILTER (WHERE p >= {c}::DOUBLE)::DOUBLE, 6) AS precision, round(count(*) FILTER (WHERE p >= {c}::DOUBLE AND label = 1) / count(*) FILTER (WHERE label = 1)::DOUBLE, 6) AS recall,
    round(2 * count(*) FILTER (WHERE p >= {c}::DOUBLE AND label = 1) / (count(*) FILTER (WHERE p >= {c}::DOUBLE) + count(*) FILTER (WHERE label = 1))::DOUBLE, 6) AS f1 FROM scored WHERE label IS NOT NULL""" for c in (0.25, 0.5, 0.75)))
def _(t):
    return metrics.confusion_at(metrics.score_curve(t.scored), [0.25, 0.5, 0.75])


@query("false_negative_breakdown", """SELECT customer_state, count(*) AS late_orders, count(*) FILTER (WHERE p < 0.6) AS missed, round(100.0 * count(*) FILTER (WHERE p < 0.6) / count(*)::DOUBLE, 6) AS miss_rate_pct,
    round(100.0 * count(*) FILTER (WHERE p < 0.6) / sum(count(*) FILTER (WHERE p < 0.6)) OVER ()::DOUBLE, 6) AS share_of_missed_pct FROM scored WHERE label = 1 GROUP BY 1""")
def _(t):
    return metrics.false_negative_breakdown(t.scored, 0.6, "customer_state")


@query("pr_curve", f"WITH {CURVE} SELECT round(score, 6) AS score, round(cp / ck::DOUBLE, 6) AS precision, round(cp / ap::DOUBLE, 6) AS recall FROM cv WHERE k > 0")
def _(t):
    return metrics.pr_curve(metrics.score_curve(t.scored))


@query("roc_curve", f"WITH {CURVE} SELECT round(score, 6) AS score, round(cp / ap::DOUBLE, 6) AS tpr, round((ck - cp) / (ak - ap)::DOUBLE, 6) AS fpr FROM cv WHERE k > 0")
def _(t):
    return metrics.roc_curve(metrics.score_curve(t.scored))


@query("operating_point", f"WITH {CURVE} SELECT round(score, 6) AS score, round(cp / ck::DOUBLE, 6) AS precision, round(cp / ap::DOUBLE, 6) AS recall FROM cv WHERE ck >= ceil(ak * 0.1::DOUBLE) AND ck - k < ceil(ak * 0.1::DOUBLE)")
def _(t):
    return metrics.operating_point(metrics.score_curve(t.scored))


@query("calibration_bins", """WITH k AS (SELECT p, label FROM scored WHERE label IS NOT NULL), e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM k),
    b AS (SELECT p, label, len(list_filter(q, lambda x: p > x)) AS bin FROM k, e) SELECT bin, count(*) AS orders, round(avg(p), 6) AS mean_predicted, round(avg(label), 6) AS observed FROM b GROUP BY 1""")
def _(t):
    return metrics.calibration_bins(t.scored)


@query("mean_probability_check", "SELECT month, round(avg(p), 6) AS mean_score, round(avg(label), 6) AS observed_rate FROM scored WHERE label IS NOT NULL GROUP BY 1")
def _(t):
    return metrics.mean_probability_check(t.scored, ["month"])


@query("binned_2d_density", "SELECT floor(target / 5)::BIGINT AS x_bin, floor(days / 5)::BIGINT AS y_bin, count(*) AS orders FROM scored WHERE target IS NOT NULL GROUP BY 1, 2")
def _(t):
    return metrics.density_2d(t.scored, "target", "days", 5.0)


@query("equal_average_ensemble", f"WITH {SQL_LONG} SELECT order_id, round(avg(sc), 6) AS p FROM sl WHERE model <> 'M0' GROUP BY 1")
def _(t):
    return metrics.ensemble_mean(long_scores(t).where("model <> 'M0'"))


@query("risk_deciles", """WITH r AS (SELECT label, row_number() OVER (ORDER BY p DESC, order_id) AS r, count(*) OVER () AS n FROM scored), g AS (SELECT CASE """ + " ".join(f"WHEN r <= ceil(n * {d} / 10.0) THEN {d}" for d in range(1, 11))
    + """ END::BIGINT AS decile, count(*) AS scored_orders, count(label) AS known_orders, coalesce(sum(label), 0)::BIGINT AS late_orders FROM r GROUP BY 1)
    SELECT *, round(100.0 * late_orders / sum(late_orders) OVER ()::DOUBLE, 6) AS capture_pct, round((late_orders / scored_orders::DOUBLE) / (sum(late_orders) OVER () / sum(scored_orders) OVER ()::DOUBLE), 6) AS lift,
    round(100.0 * sum(late_orders) OVER (ORDER BY decile) / sum(late_orders) OVER ()::DOUBLE, 6) AS cumulative_capture_pct FROM g""")
def _(t):
    return metrics.risk_deciles(t.scored)


@query("quantile_deciles", """WITH e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM scored), b AS (SELECT p, label, 10 - len(list_filter(q, lambda x: p > x)) AS decile FROM scored, e),
    g AS (SELECT decile, count(*) AS orders, coalesce(sum(label), 0)::BIGINT AS late, round(min(p), 6) AS min_score, round(max(p), 6) AS max_score FROM b GROUP BY 1)
    SELECT *, round(late / orders::DOUBLE, 6) AS late_rate, round(sum(late) OVER w / sum(orders) OVER w::DOUBLE, 6) AS cumulative_rate, round(sum(late) OVER w / sum(late) OVER ()::DOUBLE, 6) AS coverage FROM g WINDOW w AS (ORDER BY decile)""")
def _(t):
    return metrics.quantile_deciles(t.scored)


@query("monthly_rank_deciles", """WITH r AS (SELECT month, label, row_number() OVER (PARTITION BY month ORDER BY p, order_id) - 1 AS r, count(*) OVER (PARTITION BY month) - 1 AS n FROM scored WHERE label IS NOT NULL)
    SELECT month, greatest(1, (10 * r + greatest(n, 1) - 1) // greatest(n, 1))::BIGINT AS decile, count(*) AS orders, round(avg(label), 6) AS late_rate FROM r GROUP BY 1, 2""")
def _(t):
    return metrics.monthly_rank_deciles(t.scored, "month")


@query("decile_prob_range", """WITH r AS (SELECT p, row_number() OVER (ORDER BY p DESC, order_id) AS r, count(*) OVER () AS n FROM scored) SELECT (floor(10 * (r - 1) / n::DOUBLE) + 1)::BIGINT AS decile, count(*) AS orders, round(min(p), 6) AS min_p, round(max(p), 6) AS max_p FROM r GROUP BY 1""")
def _(t):
    r = ordering.global_rank(t.scored, [F.desc("p"), F.asc("order_id")])
    return r.groupBy((F.floor(10 * (F.col("rank") - 1) / F.col("n")) + 1).alias("decile")).agg(n_rows("orders"), F.min("p").alias("min_p"), F.max("p").alias("max_p"))


@query("rank_within_day", "SELECT order_id, approval_day, row_number() OVER (PARTITION BY approval_day ORDER BY p DESC, order_id) AS rank FROM scored")
def _(t):
    return ordering.global_rank(t.scored, [F.desc("p"), F.asc("order_id")], ["approval_day"]).select("order_id", "approval_day", "rank")


@query("top_fraction_flag", """WITH r AS (SELECT order_id, p, row_number() OVER (ORDER BY p DESC, order_id) AS r, count(*) OVER () AS n FROM scored), c AS (SELECT min(p) AS cut FROM r WHERE r <= ceil(n * 0.1::DOUBLE))
    SELECT order_id, r <= ceil(n * 0.1::DOUBLE) AS in_top, p >= cut AS in_top_ties FROM r, c""")
def _(t):
    flagged = ordering.top_fraction_flag(t.scored.select("order_id", "p"), 0.1, [F.desc("p"), F.asc("order_id")])
    return ordering.top_fraction_ties(flagged, 0.1, "p", "in_top_ties").select("order_id", "in_top", "in_top_ties")


@query("bootstrap_vs_leader")
def _(t):
    rows = long_scores(t).where("split = 'Validation'")
    return union_all([comparison.bootstrap_vs_leader(rows, "approval_day", k).select(F.lit(k).alias("task"), "*") for k in ("classification", "regression")])


@query("block_bootstrap_monthly")
def _(t):
    return comparison.monthly_block_bootstrap(long_scores(t), "month", "approval_day", "M1", "M2")


def _choices(t, unit):
    rows = long_scores(t).where("split = 'Validation'")
    return union_all([comparison.choose_model(comparison.bootstrap_vs_leader(rows, unit, k), {"M1": "forest", "M2": "linear"}, {"M1": 4000, "M2": 25})
                      .select(F.lit(k).alias("task"), "*") for k in ("classification", "regression")])


@query("choose_model")
def _(t):
    return _choices(t, "approval_day")


@query("choose_model_by_order")
def _(t):
    """The same choice with single orders as resampling units: the sensitivity check beside whole days."""
    return _choices(t, "order_id")


@query("paired_fold_interval", f"""WITH {FOLD_CLS}, nt AS (SELECT fold, count(*) AS nv FROM fl WHERE model = 'M1' GROUP BY 1), d AS (SELECT a.avg_precision - b.avg_precision AS d, nv / (nv * (1 + a.fold))::DOUBLE AS share FROM fcls a JOIN fcls b ON a.fold = b.fold AND b.model = 'M2' JOIN nt ON nt.fold = a.fold WHERE a.model = 'M1')
    SELECT 'M1 - M2' AS comparison, 'avg_precision' AS metric, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS sd_diff, round(avg(d) - 2.7764451051977987::DOUBLE * sqrt((0.2 + avg(share)) * var_samp(d)), 6) AS ci_low,
    round(avg(d) + 2.7764451051977987::DOUBLE * sqrt((0.2 + avg(share)) * var_samp(d)), 6) AS ci_high, count(*) FILTER (WHERE d > 0) AS folds_better, count(*) AS folds FROM d""")
def _(t):
    rows = _fold_rows(t)
    sizes = rows.where("model = 'M1'").groupBy("fold").agg(n_rows("n_valid")).withColumn("n_train", F.col("n_valid") * (1 + F.col("fold")))
    return comparison.paired_fold_interval(_cls_folds(t).join(sizes, "fold"), "M1", "M2", "avg_precision")


# ---- worklist and replay ----

WL = """wl0 AS (SELECT o.*, p, days, approved_at::DATE + 1 AS run_day, date_diff('day', approved_at::DATE + 1, estimated_at::DATE) AS left_days FROM r_orders o LEFT JOIN r_scores USING (order_id) WHERE approved_at IS NOT NULL),
    wl1 AS (SELECT *, coalesce(delivered_at < run_day, false) AS x1, estimated_at IS NULL AS x2, coalesce(left_days <= 20, false) AS x3 FROM wl0),
    wl2 AS (SELECT *, (NOT x1 AND NOT x2 AND NOT x3 AND p IS NULL) AS x4, NOT (x1 OR x2 OR x3 OR p IS NULL) AS ok FROM wl1),
    wl AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY run_day, ok ORDER BY p DESC, order_id) END AS rank, CASE WHEN ok THEN count(*) OVER (PARTITION BY run_day, ok) END AS eligible,
      CASE WHEN order_status <> 'canceled' THEN """ + label(CUTOFF) + """ END AS y, order_status = 'canceled' AS gone FROM wl2)"""


def _worklist(t, score_frame=None):
    return policy.worklist(t.orders, score_frame if score_frame is not None else t.scores, 20)


def outcomes(t):
    rows = labels.labels_as_of(t.orders, F.date_add(day("approved_at"), 46))
    gone = F.col("order_status").isin(labels.EXCLUDED_STATUSES)
    return rows.select("order_id", F.when(~gone, F.col("label")).alias("label"), gone.alias("canceled"))


def _replay(t, score_frame=None):
    return policy.attach_outcomes(_worklist(t, score_frame), outcomes(t))


@query("worklist_candidates", "SELECT order_id, approved_at::DATE + 1 AS run_day FROM r_orders WHERE approved_at IS NOT NULL AND NOT coalesce(delivered_at < approved_at::DATE + 1, false)")
def _(t):
    return policy.candidates(t.orders).select("order_id", "run_day")


@query("build_worklist", f"""WITH {WL} SELECT order_id, run_day, concat_ws(',', CASE WHEN x1 THEN 'already_delivered' END, CASE WHEN x2 THEN 'missing_promised_delivery_date' END, CASE WHEN x3 THEN 'insufficient_time_remaining' END, CASE WHEN x4 THEN 'invalid_model_inputs' END) AS reasons,
    rank, coalesce(rank <= ceil(eligible * 0.3::DOUBLE), false) AS follow_up FROM wl""")
def _(t):
    return _worklist(t).select("order_id", "run_day", F.array_join("reasons", ",").alias("reasons"), "rank", policy.selected(0.3).alias("follow_up"))


@query("exclusion_reason_counts", f"""WITH {WL} SELECT run_day, reason, count(*) AS orders FROM (SELECT run_day, unnest([CASE WHEN x1 THEN 'already_delivered' END, CASE WHEN x3 THEN 'insufficient_time_remaining' END, CASE WHEN x4 THEN 'invalid_model_inputs' END]) AS reason FROM wl) WHERE reason IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return policy.exclusion_counts(_worklist(t))


@query("month_replay", f"WITH {WL} SELECT order_id, run_day, rank, y::BIGINT AS label, gone AS canceled FROM wl")
def _(t):
    return _replay(t).select("order_id", "run_day", "rank", "label", "canceled")


SUMMARY = """SELECT run_day, CASE WHEN grouping(run_day) = 1 THEN 'pooled' ELSE 'day' END AS level, count(*) AS total, count(rank) AS eligible, count(*) FILTER (WHERE s) AS selected, count(y) FILTER (WHERE s) AS selected_known, count(y) AS known_all,
    count(*) FILTER (WHERE s AND y = 1) AS late_caught, count(*) FILTER (WHERE rank IS NOT NULL AND y = 1) AS late_eligible, count(*) FILTER (WHERE y = 1) AS late_all FROM (SELECT *, coalesce(rank <= ceil(eligible * 0.3::DOUBLE), false) AS s FROM wl) GROUP BY ROLLUP (run_day)"""


@query("month_summary", f"""WITH {WL}, s AS ({SUMMARY}) SELECT *, round(late_caught / nullif(selected_known, 0)::DOUBLE, 6) AS selected_late_rate, round(late_caught / nullif(late_eligible, 0)::DOUBLE, 6) AS eligible_late_coverage,
    round(late_caught / nullif(late_all, 0)::DOUBLE, 6) AS all_late_coverage FROM s""")
def _(t):
    return policy.month_summary(_replay(t), 0.3)


@query("cumulative_caught", f"WITH {WL}, s AS ({SUMMARY}) SELECT run_day, sum(late_all) OVER w::BIGINT AS late_so_far, sum(late_caught) OVER w::BIGINT AS caught_so_far FROM s WHERE level = 'day' WINDOW w AS (ORDER BY run_day)")
def _(t):
    return policy.cumulative_caught(policy.month_summary(_replay(t), 0.3))


def _rank_sql(score):
    return f"""m0 AS (SELECT o.order_id, strftime(approved_at, '%Y-%m') AS month, {score} AS sc, CASE WHEN order_status <> 'canceled' THEN {label(CUTOFF)} END AS y FROM r_orders o JOIN r_scores USING (order_id) WHERE approved_at IS NOT NULL AND p IS NOT NULL),
    mr AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY sc DESC, order_id) AS rank, count(*) OVER (PARTITION BY month) AS n FROM m0)"""


RANK_OUT = """SELECT month, count(*) AS total, count(*) FILTER (WHERE rank <= ceil(n * 0.3::DOUBLE)) AS selected, count(*) FILTER (WHERE rank <= ceil(n * 0.3::DOUBLE) AND y = 1) AS late_caught, count(*) FILTER (WHERE y = 1) AS late_all,
    round(count(*) FILTER (WHERE rank <= ceil(n * 0.3::DOUBLE) AND y = 1) / nullif(count(*) FILTER (WHERE y = 1), 0)::DOUBLE, 6) AS all_late_coverage FROM mr GROUP BY 1"""


@query("monthly_ranking", f"WITH {_rank_sql('p')} {RANK_OUT}")
def _(t):
    return policy.monthly_ranking(t.orders, t.scores.drop("days"), outcomes(t), 0.3)


@query("buffer_ranking", f"WITH {_rank_sql('days')} {RANK_OUT}")
def _(t):
    return policy.monthly_ranking(t.orders, policy.buffer_scores(t.scores), outcomes(t), 0.3)


SHARES = [round(0.05 * i, 2) for i in range(21)]


@query("effort_curve", f"""WITH {WL}, {_rank_sql('p')}, g AS (SELECT unnest([{', '.join(map(str, SHARES))}])::DOUBLE AS share), b AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY run_day, ok ORDER BY days DESC, order_id) END AS brank FROM wl), tot AS (SELECT count(*) FILTER (WHERE y = 1) AS t FROM wl)
    SELECT method, share, count(*) FILTER (WHERE s) AS selected, count(*) FILTER (WHERE s AND y = 1) AS late_caught, round(count(*) FILTER (WHERE s AND y = 1) / any_value(t)::DOUBLE, 6) AS coverage FROM
    (SELECT 'daily' AS method, share, rank <= ceil(share * eligible) AS s, y FROM wl, g WHERE ok UNION ALL SELECT 'buffer', share, brank <= ceil(share * eligible), y FROM b, g WHERE ok UNION ALL SELECT 'monthly', share, rank <= ceil(share * n), y FROM mr, g), tot GROUP BY 1, 2""")
def _(t):
    daily = _replay(t)
    late = outcomes(t).where("label = 1").count()
    buffer = policy.attach_outcomes(_worklist(t, policy.buffer_scores(t.scores)), outcomes(t))
    monthly = ordering.global_rank(
        t.orders.where("approved_at IS NOT NULL").select("order_id", F.date_format(day("approved_at"), "yyyy-MM").alias("month"))
        .join(t.scores.where("p IS NOT NULL"), "order_id").join(outcomes(t), "order_id", "left"), [F.desc("p"), F.asc("order_id")], ["month"])
    return union_all([policy.effort_curve(daily, "rank", "eligible", late, SHARES, "daily"),
                      policy.effort_curve(buffer, "rank", "eligible", late, SHARES, "buffer"),
                      policy.effort_curve(monthly, "rank", "n", late, SHARES, "monthly")])


@query("timing_accuracy", """SELECT approval_day, CASE WHEN grouping(approval_day) = 1 THEN 'all' ELSE 'day' END AS level, count(*) AS n, round(avg(abs(days - target)), 6) AS mae, round(sqrt(avg((days - target) * (days - target))), 6) AS rmse, round(avg(days - target), 6) AS bias,
    round(avg(target), 6) AS mean_actual, round(avg(days), 6) AS mean_predicted, round(avg(days) FILTER (WHERE label = 1), 6) AS predicted_late, round(avg(days) FILTER (WHERE label = 0), 6) AS predicted_on_time FROM scored WHERE target IS NOT NULL GROUP BY ROLLUP (approval_day)""")
def _(t):
    return policy.timing_accuracy(t.scored)


@query("retrospective_counts", f"""WITH {WL}, x AS (SELECT 'all' AS population, y, gone FROM wl UNION ALL SELECT 'eligible', y, gone FROM wl WHERE ok UNION ALL SELECT 'selected', y, gone FROM wl WHERE rank <= ceil(eligible * 0.3::DOUBLE))
    SELECT population, count(*) AS total, count(y) AS known, count(*) FILTER (WHERE y IS NULL AND NOT gone) AS unknown, count(*) FILTER (WHERE gone) AS canceled, count(*) FILTER (WHERE y = 1) AS late, round(count(*) FILTER (WHERE y = 1) / nullif(count(y), 0)::DOUBLE, 6) AS late_rate FROM x GROUP BY 1""")
def _(t):
    return policy.retrospective_counts(_replay(t), 0.3)


@query("monthly_risk_vs_actual", " UNION ALL ".join(f"""SELECT '{k}' AS view, {c} AS segment, count(*) AS orders, round(avg(label), 6) AS late_rate, round(avg(p), 6) AS mean_risk, round(avg(target), 6) AS mean_actual_days, round(avg(days), 6) AS mean_predicted_days
    FROM scored GROUP BY 2 HAVING count(*) >= {m}""" for k, c, m in (("month", "month", 1), ("state", "customer_state", 100))))
def _(t):
    return union_all([policy.risk_vs_actual(t.scored, c, m).select(F.lit(k).alias("view"), F.col(c).alias("segment"), "orders", "late_rate", "mean_risk", "mean_actual_days", "mean_predicted_days")
                      for k, c, m in (("month", "month", 1), ("state", "customer_state", 100))])


def _mon(v, src):
    return f"SELECT '{v}' AS view, count(*) AS records, round(avg(score), 6) AS mean_score, max(ts)::DATE AS last_day FROM ({src})"


@query("prediction_monitor", " UNION ALL ".join([_mon("all", "SELECT * FROM r_log"), _mon("recent", "SELECT * FROM r_log ORDER BY ts DESC, event_id DESC LIMIT 1000"), _mon("warnings", "SELECT * FROM r_log WHERE score > 1 OR score < 0"),
                                                 _mon("recent warnings", "SELECT * FROM r_log WHERE score > 1 OR score < 0 ORDER BY ts DESC, event_id DESC LIMIT 20")]))
def _(t):
    return policy.prediction_monitor(t.prediction_log)
