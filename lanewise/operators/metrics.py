"""Ranking, probability and error metrics as aggregations over scored rows.

Everything that depends on the order of scores reads one small table, the score
curve: counts per distinct score with running totals. Rows themselves are ranked only
where a cut falls inside a group of equal scores.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite, join_groups, n_rows, percent, ratio
from ..functions.times import col
from .ordering import exact_quantiles, global_rank, prefix_sums, qcut_code, quantile_edges


def score_curve(df: DataFrame, by: Sequence[str] = (), score: str = "p", label: str = "label") -> DataFrame:
    """Per distinct score, highest first: n rows, k known, pos late, each with cum_ and all_ totals."""
    y = F.col(label).cast("bigint")
    counts = df.where(finite(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        n_rows("n"), F.count(y).alias("k"), F.coalesce(F.sum(y), F.lit(0)).alias("pos"))
    return prefix_sums(counts, by, [F.desc("score")], {c: F.col(c) for c in ("n", "k", "pos")})


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0))


def ranking_scores(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision by steps, ROC-AUC with tied midranks, and Brier loss."""
    neg = F.col("k") - F.col("pos")
    both = (F.col("P") > 0) & (F.col("P") < F.col("K"))
    ap = F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("cum_pos") / F.col("cum_k")))
    auc = F.sum(neg * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0))
    loss = F.sum(F.col("pos") * F.pow(F.col("score") - 1, 2) + neg * F.pow(F.col("score"), 2))
    flagged = F.col("score") >= 0.5
    out = curve.groupBy(*by).agg(
        F.max("all_n").alias("n_scored"), F.max("all_k").alias("K"), F.max("all_pos").alias("P"), ap.alias("_ap"),
        auc.alias("_auc"), loss.alias("_loss"), F.sum(F.when(flagged, F.col("pos"))).alias("_tp"),
        F.sum(F.when(flagged, F.col("k"))).alias("_flag"))
    tp, fl = F.coalesce("_tp", F.lit(0)), F.coalesce("_flag", F.lit(0))
    p50, r50 = F.coalesce(ratio(tp, fl), F.lit(0.0)), F.coalesce(ratio(tp, "P"), F.lit(0.0))
    return out.select(*by, "n_scored", F.col("K").alias("n_known"), F.col("P").alias("n_late"), ratio("P", "K").alias("late_rate"),
                      F.when(both, F.col("_ap") / F.col("P")).alias("avg_precision"),
                      F.when(both, ratio("_auc", F.col("P") * (F.col("K") - F.col("P")))).alias("roc_auc"),
                      ratio("_loss", "K").alias("brier"), p50.alias("precision_at_0_5"), r50.alias("recall_at_0_5"),
                      _f1(p50, r50).alias("f1_at_0_5"))


def top_late(df: DataFrame, curve: DataFrame, by: Sequence[str], fraction: float, score: str, label: str,
             id_col: str) -> DataFrame:
    """Size of the top group and the known late rows in it; ties at the cut go by id.

    Only the rows that share the cut score are ranked.
    """
    top = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("all_n")))
    cut = curve.withColumn("top_count", top).where((F.col("cum_n") >= F.col("top_count")) & (F.col("cum_n") - F.col("n") < F.col("top_count"))) \
        .select(*by, F.col("score").alias(score), "top_count", (F.col("cum_pos") - F.col("pos")).alias("_above"),
                (F.col("top_count") - F.col("cum_n") + F.col("n")).alias("_need"))
    tied = join_groups(df.select(*by, score, id_col, label), cut.select(*by, score, "_need"), [*by, score])
    inside = global_rank(tied, [F.asc(id_col)], by).where(F.col("rank") <= F.col("_need"))
    extra = inside.groupBy(*by, score).agg(F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("_extra"))
    return join_groups(cut, extra, [*by, score], "left").select(*by, "top_count", (F.col("_above") + F.coalesce("_extra", F.lit(0))).alias("top_late"))


def classification_metrics(df: DataFrame, by: Sequence[str] = (), fraction: float = 0.1, score: str = "p",
                           label: str = "label", id_col: str = "order_id") -> DataFrame:
    """One row per group; unknown labels stay ranked and never count as late."""
    by = list(by)
    curve = score_curve(df, by, score, label)
    base, top = ranking_scores(curve, by), top_late(df, curve, by, fraction, score, label, id_col)
    both = join_groups(base, top, by)
    prec, rec = ratio("top_late", "top_count"), ratio("top_late", "n_late")
    return (both.withColumn("precision_top10", prec).withColumn("recall_top10", rec)
            .withColumn("f1_top10", F.when(F.col("n_late") > 0, _f1(prec, rec)).otherwise(F.lit(0.0)))
            .withColumn("top10_lift", ratio("recall_top10", F.col("top_count") / F.col("n_scored"))).drop("top_late", "top_count"))


def regression_metrics(df: DataFrame, by: Sequence[str] = (), actual: str = "target", predicted: str = "days") -> DataFrame:
    known = df.where(finite(actual).isNotNull() & finite(predicted).isNotNull()) \
        .withColumn("_e", F.col(predicted) - F.col(actual)).withColumn("_a", F.abs("_e"))
    sq = F.col("_e") * F.col("_e")
    sums = known.groupBy(*by).agg(n_rows("n"), F.avg("_a").alias("mae"), F.sqrt(F.avg(sq)).alias("rmse"),
                                  (1 - ratio(F.sum(sq), F.count("_e") * F.var_pop(actual))).alias("r2"), F.avg("_e").alias("bias"))
    mid = exact_quantiles(known, by, ["_a"], {"median_ae": 0.5}).select(*by, "median_ae")
    return join_groups(sums, mid, list(by))


def regression_split_metrics(df: DataFrame, by: Sequence[str] = (), actual: str = "target", predicted: str = "days",
                             late: str | None = None) -> DataFrame:
    """Adds errors of late and on-time rows, the derived late flag, and unknown counts."""
    base = regression_metrics(df, by, actual, predicted)
    e = F.col(predicted) - F.col(actual)
    ok = finite(actual).isNotNull() & finite(predicted).isNotNull()
    is_late = (F.col(late) == 1) if late else (F.col(actual) > 0)
    usable = ok & (F.col(late).isNotNull() if late else F.lit(True))
    yes, no, flag = usable & is_late, usable & ~is_late, usable & (F.col(predicted) > 0)
    extra = df.groupBy(*by).agg(
        F.sqrt(F.avg(F.when(yes, e * e))).alias("rmse_late"), F.avg(F.when(yes, F.abs(e))).alias("mae_late"),
        F.sqrt(F.avg(F.when(no, e * e))).alias("rmse_on_time"), F.avg(F.when(no, F.abs(e))).alias("mae_on_time"),
        F.count_if(flag & yes).alias("_tp"), F.count_if(flag).alias("_f"), F.count_if(yes).alias("n_actual_late"),
        F.count_if(F.col(actual).isNull()).alias("n_unknown"))
    p, r = F.coalesce(ratio("_tp", "_f"), F.lit(0.0)), F.coalesce(ratio("_tp", "n_actual_late"), F.lit(0.0))
    extra = extra.withColumn("late_flag_precision", p).withColumn("late_flag_recall", r).withColumn("late_flag_f1", _f1(p, r)).drop("_tp", "_f")
    return join_groups(base, extra, list(by))


def risk_deciles(df: DataFrame, by: Sequence[str] = (), score: str = "p", label: str = "label", id_col: str = "order_id") -> DataFrame:
    """Ten near-equal groups by (score desc, id); capture, lift and cumulative capture."""
    by = list(by)
    ranked = global_rank(df.where(finite(score).isNotNull()), [F.desc(score), F.asc(id_col)], by)
    tenth = ranked.withColumn("decile", (F.floor(10 * (F.col("rank") - 1) / F.col("n")) + 1).cast("int"))
    groups = tenth.groupBy(*by, "decile").agg(n_rows("scored_orders"), F.count(label).alias("known_orders"),
                                              F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("late_orders"))
    whole = Window.partitionBy(*by)
    running = whole.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total, scored = F.sum("late_orders").over(whole), F.sum("scored_orders").over(whole)
    return groups.withColumn("capture_pct", percent("late_orders", total)) \
        .withColumn("lift", ratio(F.col("late_orders") / F.col("scored_orders"), total / scored)) \
        .withColumn("cumulative_capture_pct", percent(F.sum("late_orders").over(running), total))


def quantile_deciles(df: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """Quantile-edge groups (equal edges merged), riskiest first, with running rate and coverage."""
    known = df.where(finite(score).isNotNull())
    edges = quantile_edges(known, score, 10)
    groups = max(len(edges) - 1, 1)
    agg = known.groupBy((F.lit(groups) - qcut_code(score, edges)).alias("decile")).agg(
        n_rows("orders"), F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("late"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"))
    run = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    late, orders = F.sum("late").over(run), F.sum("orders").over(run)
    return agg.select("decile", "orders", "late", "min_score", "max_score", ratio("late", "orders").alias("late_rate"),
                      ratio(late, orders).alias("cumulative_rate"), ratio(late, F.sum("late").over(Window.partitionBy())).alias("coverage"))


def monthly_rank_deciles(df: DataFrame, month: str, score: str = "p", label: str = "label", id_col: str = "order_id") -> DataFrame:
    """Tenths of the within-month rank among known outcomes, 10 = riskiest."""
    r = global_rank(df.where(F.col(label).isNotNull() & F.col(score).isNotNull()), [F.asc(score), F.asc(id_col)], [month])
    steps = F.greatest(F.col("n") - 1, F.lit(1))
    tenth = F.greatest(F.lit(1), F.ceil(10 * (F.col("rank") - 1) / steps))
    return r.groupBy(month, tenth.cast("int").alias("decile")).agg(n_rows("orders"), F.avg(label).alias("late_rate"))


def f1_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cut-off with the largest F1; of equal ones the lowest score."""
    f1 = ratio(2 * F.col("cum_pos"), F.col("cum_k") + F.col("all_pos"))
    return curve.where("k > 0").withColumn("f1", f1).groupBy(*by).agg(
        F.max_by("score", F.struct("f1", -F.col("score"))).alias("threshold"), F.max("f1").alias("f1"))


def confusion_at(curve: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """Confusion counts at several cut-offs in one pass over the curve."""
    steps = curve.withColumn("threshold", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])))
    hit = F.col("score") >= F.col("threshold")
    neg = F.col("k") - F.col("pos")
    out = steps.groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("true_positive"), F.sum(F.when(hit, neg).otherwise(0)).alias("false_positive"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("false_negative"), F.sum(F.when(~hit, neg).otherwise(0)).alias("true_negative"))
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    p, r = F.coalesce(ratio(tp, tp + fp), F.lit(0.0)), F.coalesce(ratio(tp, tp + fn), F.lit(0.0))
    return out.withColumn("flagged_pct", percent(tp + fp, tp + fp + fn + tn)).withColumn("precision", p).withColumn("recall", r).withColumn("f1", _f1(p, r))


def false_negative_breakdown(df: DataFrame, threshold: float, segment: str, score: str = "p", label: str = "label") -> DataFrame:
    """Known late rows below the cut-off by segment, with the segment's share of all misses."""
    late = df.where((F.col(label) == 1) & F.col(segment).isNotNull())
    table = late.groupBy(segment).agg(n_rows("late_orders"), F.count_if(F.col(score) < threshold).alias("missed"))
    everything = F.greatest(F.sum("missed").over(Window.partitionBy()), F.lit(1))
    return table.withColumn("miss_rate_pct", percent("missed", "late_orders")).withColumn("share_of_missed_pct", percent("missed", everything))


def pr_curve(curve: DataFrame) -> DataFrame:
    return curve.where("k > 0").select("score", ratio("cum_pos", "cum_k").alias("precision"), ratio("cum_pos", "all_pos").alias("recall"))


def roc_curve(curve: DataFrame) -> DataFrame:
    return curve.where("k > 0").select("score", ratio("cum_pos", "all_pos").alias("tpr"),
                                       ratio(F.col("cum_k") - F.col("cum_pos"), F.col("all_k") - F.col("all_pos")).alias("fpr"))


def operating_point(curve: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Precision and recall when every score at or above the capacity cut is flagged."""
    top = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("all_k")))
    return curve.where((F.col("cum_k") >= top) & (F.col("cum_k") - F.col("k") < top)).select(
        "score", ratio("cum_pos", "cum_k").alias("precision"), ratio("cum_pos", "all_pos").alias("recall"))


def calibration_bins(df: DataFrame, bins: int = 10, score: str = "p", label: str = "label") -> DataFrame:
    """Mean score against observed rate in equal-count bins of known rows (left-closed inner edges)."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    edges = quantile_edges(known, score, bins)
    code = F.lit(0)
    for e in edges[1:-1]:
        code = code + (F.col(score) > e).cast("int")
    return known.groupBy(code.alias("bin")).agg(n_rows("orders"), F.avg(score).alias("mean_predicted"), F.avg(label).alias("observed"))


def mean_probability_check(df: DataFrame, by: Sequence[str], score: str = "p", label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(F.avg(score).alias("mean_score"), F.avg(label).alias("observed_rate"))


def density_2d(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / width).cast("int")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cell(x).alias("x_bin"), cell(y).alias("y_bin")).agg(n_rows("orders"))


def ensemble_mean(parts: DataFrame, id_col: str = "order_id", score: str = "p") -> DataFrame:
    return parts.groupBy(id_col).agg(F.avg(score).alias(score))


# ---- tables over (model, split) and (model, fold) results ----

def cv_mean_sd(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return folds.groupBy("model").agg(*[f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))])


def comparison_table(results: DataFrame, folds: DataFrame, metric: str, splits: Sequence[str], scale: float = 1.0) -> DataFrame:
    wide = results.groupBy("model").pivot("split", list(splits)).agg(F.max(F.col(metric) * scale))
    cv = cv_mean_sd(folds, [metric]).select("model", (F.col(f"{metric}_mean") * scale).alias("cv_mean"), (F.col(f"{metric}_sd") * scale).alias("cv_sd"))
    return wide.join(cv, "model", "left")


def overfitting_gaps(results: DataFrame, folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    cv = cv_mean_sd(folds, metrics)
    return results.where("split = 'Train'").join(cv, "model").select("model", *[(F.col(m) - F.col(f"{m}_mean")).alias(m) for m in metrics])


def tuning_gain(results: DataFrame, folds: DataFrame, tuned: str, default: str, metrics: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Tuned minus default per metric and split; CV uses fold means."""
    cv = folds.groupBy("model").agg(*[F.avg(m).alias(m) for m in metrics]).withColumn("split", F.lit("CV"))
    rows = results.where(F.col("split").isin(list(splits))).select("model", "split", *metrics).unionByName(cv.select("model", "split", *metrics))
    long = rows.where(F.col("model").isin(tuned, default)).unpivot(["model", "split"], list(metrics), "metric", "value")
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("value")))
    return long.groupBy("metric", "split").agg(pick(tuned).alias("tuned"), pick(default).alias("baseline")) \
        .withColumn("gain", F.col("tuned") - F.col("baseline"))


def drift_table(results: DataFrame, metrics: Sequence[str], periods: Sequence[str]) -> DataFrame:
    long = results.where(F.col("split").isin(list(periods))).unpivot(["model", "split"], list(metrics), "metric", "value")
    wide = long.groupBy("model", "metric").pivot("split", list(periods)).agg(F.max("value"))
    return wide.withColumn("change", F.col(periods[-1]) - F.col(periods[0]))


def split_table(results: DataFrame, metrics: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Model rows, one column per split and metric."""
    return results.groupBy("model").pivot("split", list(splits)).agg(*[F.max(m).alias(m) for m in metrics])


def success_classification(results: DataFrame, baseline: str, linear: Sequence[str], forests: Sequence[str],
                           ap_ratio: float = 2.0, precision_ratio: float = 1.1) -> DataFrame:
    base = results.where(F.col("model") == baseline).select("split", F.col("avg_precision").alias("_b"))
    uplift = results.where(F.col("model") != baseline).join(base, "split").select(
        "split", "model", F.lit("AP against no-skill").alias("criterion"), ratio("avg_precision", "_b").alias("value"), F.lit(ap_ratio).alias("threshold"))
    best = results.where(F.col("model").isin(list(linear))).groupBy("split").agg(F.max("precision_top10").alias("_p"))
    forest = results.where(F.col("model").isin(list(forests))).join(best, "split").select(
        "split", "model", F.lit("top-10% precision against best linear").alias("criterion"), F.col("precision_top10").alias("value"),
        (F.lit(precision_ratio) * F.col("_p")).alias("threshold"))
    return uplift.unionByName(forest).withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def success_regression(results: DataFrame, references: Mapping[str, float], linear: Sequence[str], forests: Sequence[str]) -> DataFrame:
    """Relative RMSE gain over each reference model (with its minimum gain), and forests over the best linear."""
    parts = []
    for ref, need in references.items():
        base = results.where(F.col("model") == ref).select("split", F.col("rmse").alias("_b"))
        gain = 1 - ratio("rmse", "_b")
        ok = gain >= need if need else gain > 0
        parts.append(results.where(~F.col("model").isin(list(references))).join(base, "split").select(
            "split", "model", F.lit(f"RMSE below {ref}").alias("criterion"), gain.alias("value"), F.lit(need).cast("double").alias("threshold"), ok.alias("passed")))
    best = results.where(F.col("model").isin(list(linear))).groupBy("split").agg(F.min("rmse").alias("_b"))
    parts.append(results.where(F.col("model").isin(list(forests))).join(best, "split").select(
        "split", "model", F.lit("gain over best linear (reported)").alias("criterion"), (1 - ratio("rmse", "_b")).alias("value"),
        F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("boolean").alias("passed")))
    from .audits import union_all
    return union_all(parts)


def hyperparameter_sensitivity(search: DataFrame, params: Sequence[str]) -> DataFrame:
    """Best candidate score per value of each parameter, best and worst value, spread."""
    long = search.select("mean_score", *[F.coalesce(F.col(p).cast("string"), F.lit("None")).alias(p) for p in params]) \
        .unpivot("mean_score", list(params), "parameter", "value")
    best = long.groupBy("parameter", "value").agg(F.max("mean_score").alias("score"))
    return best.groupBy("parameter").agg(F.max_by("value", F.struct("score", "value")).alias("best_value"), F.max("score").alias("best_score"),
                                         F.min_by("value", F.struct("score", "value")).alias("worst_value"), F.min("score").alias("worst_score")) \
        .withColumn("spread", F.col("best_score") - F.col("worst_score"))
