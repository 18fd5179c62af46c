import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise.operators import comparison, contract, features, metrics, ml, policy, stats


def average_precision(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = np.asarray(y)[order], np.asarray(s)[order]
    ends = np.r_[np.flatnonzero(np.diff(s)), len(s) - 1]
    tp = np.cumsum(y)[ends]
    return float((np.diff(np.r_[0, tp]) * tp / (ends + 1)).sum() / y.sum())


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg)))


def scored(spark, n=600, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = 0.4 if i % 3 == 0 else round(rng.random(), 2)
        rows.append((i, p, None if i % 17 == 0 else int(rng.random() < p), dt.date(2018, 6, 1 + i % 28)))
    return spark.createDataFrame(rows, "order_id long, p double, label int, day date"), pd.DataFrame(rows, columns=["order_id", "p", "label", "day"])


def test_ranking_metrics_by_brute_force(spark):
    df, pdf = scored(spark)
    got = metrics.classification_metrics(df).first()
    known = pdf.dropna(subset=["label"])
    y, s = known["label"].to_numpy(int), known["p"].to_numpy()
    top = pdf.sort_values(["p", "order_id"], ascending=[False, True]).head(int(np.ceil(len(pdf) * 0.1)))
    assert np.isclose(got["avg_precision"], average_precision(y, s)) and np.isclose(got["roc_auc"], auc(y, s))
    assert np.isclose(got["brier"], ((s - y) ** 2).mean())
    assert np.isclose(got["precision_top10"], top["label"].fillna(0).sum() / len(top))
    assert got["n_scored"] == len(pdf) and got["n_known"] == len(known)


def test_one_class_has_no_ranking_metric(spark):
    got = metrics.classification_metrics(spark.createDataFrame([(1, 0.2, 0), (2, 0.9, 0)], "order_id long, p double, label int")).first()
    assert got["avg_precision"] is None and got["roc_auc"] is None and got["recall_top10"] is None


def test_deciles_keep_unknown_labels(spark):
    df, pdf = scored(spark, 603)
    rows = metrics.risk_deciles(df).orderBy("decile").collect()
    sizes = [r["scored_orders"] for r in rows]
    assert sum(sizes) == 603 and max(sizes) - min(sizes) <= 1 and [np.ceil(603 * d / 10) for d in range(1, 11)] == list(np.cumsum(sizes))
    assert sum(r["late_orders"] for r in rows) == pdf["label"].sum() and np.isclose(rows[-1]["cumulative_capture_pct"], 100)


def test_f1_threshold_prefers_the_first_maximum(spark):
    df, pdf = scored(spark)
    known = pdf.dropna(subset=["label"])
    best = max(((2 * ((known["p"] >= c) & (known["label"] == 1)).sum() / ((known["p"] >= c).sum() + known["label"].sum())), -c) for c in known["p"].unique())
    assert np.isclose(metrics.f1_threshold(metrics.score_curve(df)).first()["threshold"], -best[1])


@pytest.mark.parametrize("unit", ["day", "order_id"])
def test_bootstrap_ap_equals_rescoring_every_draw(spark, unit, monkeypatch):
    """Days from one table of draws; single orders with their draws taken along, in blocks that cut a score held by a third of them."""
    if unit == "order_id":
        monkeypatch.setattr(comparison, "TABLE_CELLS", 25 * 40)
    df, _ = scored(spark)
    both = df.withColumn("model", F.lit("a")).unionByName(df.withColumn("p", F.when(F.col("order_id") % 3 == 0, 0.5).otherwise(F.round(1 - F.col("p") / 2, 2))).withColumn("model", F.lit("b")))
    got = comparison.bootstrap_ap(both, unit, 25, seed=9).toPandas().set_index(["model", "b"])["value"]
    pdf = both.where("label IS NOT NULL").toPandas()
    units = sorted(set(pdf[unit]))
    draws = comparison.draw_table([len(units)], 25, 9)
    assert len(got) == 50 and (draws.sum(0) == len(units)).all()
    pdf["u"] = pdf[unit].map({d: i for i, d in enumerate(units)})
    for b in (0, 7, 24):
        for model, g in pdf.groupby("model"):
            rows = g.loc[g.index.repeat(draws[g["u"], b])]
            assert np.isclose(got[(model, b)], average_precision(rows["label"].to_numpy(int), rows["p"].to_numpy()))


def test_bootstrap_rmse_over_single_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(m, i, float(rng.normal()), float(rng.normal()) if i % 50 else None) for m in ("a", "b") for i in range(9000)]
    df = spark.createDataFrame(rows, "model string, order_id long, days double, target double")
    pdf = df.where("target IS NOT NULL").toPandas()
    units = sorted(set(pdf["order_id"]))
    draws, at = comparison.draw_table([len(units)], 20, 3), {u: i for i, u in enumerate(units)}
    for cells in (20 * 9000, 20 * 100):
        monkeypatch.setattr(comparison, "TABLE_CELLS", cells)
        got = comparison.bootstrap_rmse(df, "order_id", 20, 3).toPandas().set_index(["model", "b"])["value"]
        for model, g in pdf.groupby("model"):
            m = draws[g["order_id"].map(at)]
            want = np.sqrt((m * ((g["days"] - g["target"]) ** 2).to_numpy()[:, None]).sum(0) / m.sum(0))
            assert np.allclose(got[model].sort_index(), want)


def test_draws_are_multinomial_over_blocks():
    n, draws = 2 * comparison.UNIT_BLOCK + 700, 300
    table = comparison.draw_table([n], draws, 5)
    assert table.shape == (n, draws) and (table.sum(0) == n).all()
    assert abs(table.var(1).mean() - (1 - 1 / n)) < 0.01 and abs((table == 0).mean() - (1 - 1 / n) ** n) < 0.003
    last = comparison.block_totals(n, draws, 5, 2)
    assert abs(last.mean() - 700) < 5 and abs(last.var() - 700 * (1 - 700 / n)) < 150
    again = comparison.multiplicities(n, draws, 5, 1)
    assert (again == table[comparison.UNIT_BLOCK:2 * comparison.UNIT_BLOCK]).all()


def test_choose_simplest_tied_model(spark):
    table = spark.createDataFrame([("F", 0.3, 0.0, 0.0, 0.0, True, True), ("L", 0.29, -0.01, -0.03, 0.01, False, True), ("T", 0.2, -0.1, -0.2, -0.05, False, False), ("B", 0.1, -0.2, -0.3, -0.1, False, False)],
                                  "model string, score double, diff_vs_leader double, ci_low double, ci_high double, leader boolean, tied boolean")
    got = {r["model"]: r["decision"] for r in comparison.choose_model(table, {"F": "forest", "L": "linear", "T": "tree"}, {"F": 900, "L": 20, "T": 8}).collect()}
    assert got["L"].startswith("selected") and got["F"].startswith("tied, but") and got["T"].startswith("not tied") and got["B"].startswith("baseline")


def test_worklist_boundary(spark):
    t = dt.datetime.fromisoformat
    rows = [("c", "2018-06-01", "2018-06-20", None, 0.9), ("a", "2018-06-01", "2018-06-20", None, 0.5), ("b", "2018-06-01", "2018-06-20", None, 0.1),
            ("at", "2018-06-01", "2018-06-20", "2018-06-02T00:00:00", 0.4), ("before", "2018-06-01", "2018-06-20", "2018-06-01T23:59:59", 0.8),
            ("no_promise", "2018-06-01", None, None, 0.7), ("short", "2018-06-01", "2018-06-03", None, 0.6), ("bad", "2018-06-01", "2018-06-20", None, None)]
    orders = spark.createDataFrame([(i, t(a), t(e) if e else None, t(d) if d else None) for i, a, e, d, _ in rows],
                                   "order_id string, approved_at timestamp_ntz, estimated_at timestamp_ntz, delivered_at timestamp_ntz")
    scores = spark.createDataFrame([(r[0], r[4]) for r in rows], "order_id string, p double")
    wl = policy.worklist(orders, scores, 1).withColumn("pick", policy.selected(0.3))
    ranked = [r["order_id"] for r in wl.where("rank IS NOT NULL").orderBy("rank").collect()]
    assert ranked == ["c", "a", "at", "b"]
    assert [r["order_id"] for r in wl.where("pick").orderBy("rank").collect()] == ["c", "a"]  # ceil(0.3 * 4)
    assert {r["reason"]: r["orders"] for r in policy.exclusion_counts(wl).collect()} == {
        "already_delivered": 1, "missing_promised_delivery_date": 1, "insufficient_time_remaining": 1, "invalid_model_inputs": 1}
    for bad in (True, -1, 400):
        with pytest.raises(ValueError):
            policy.worklist(orders, scores, bad)


def test_payment_profile(spark):
    pay = spark.createDataFrame([("x", "voucher", 1), ("x", "credit_card", 3), ("x", "voucher", 1), ("y", "credit_card", 2)], "order_id string, payment_type string, installments int")
    got = {r["order_id"]: (r["payment_combination"], r["payment_installments_max"]) for r in features.payment_profile(pay).collect()}
    assert got == {"x": ("credit_card+voucher", 3), "y": ("credit_card", 2)}
    with pytest.raises(ValueError):
        features.assert_no_leakage(["promised_lead_days", "delivered_at"])


def test_contract_rules(spark):
    df = spark.createDataFrame([("ok", 3.0, 2.0, 29.0, "A"), ("feb30", 3.0, 2.0, 30.0, "A"), ("frac", 2.5, 2.0, 1.0, "A"), ("big", 1e13, 1.0, 1.0, "A"),
                                ("inf", float("inf"), 1.0, 1.0, "A"), ("level", 1.0, 1.0, 1.0, None), ("empty", None, None, None, "A")],
                               "id string, order_item_count double, order_approved_month double, order_approved_day_of_month double, c string")
    got = {r["id"]: r["violations"] for r in contract.validate(df, ["order_item_count", "order_approved_month", "order_approved_day_of_month"], {"c": ["A"]}).collect()}
    assert got["ok"] == [] and got["feb30"] == ["day not in month"] and got["frac"] == ["order_item_count: count"]
    assert got["big"] == ["order_item_count: magnitude"] and "order_item_count: not finite" in got["inf"]
    assert got["level"] == ["c: category"] and got["empty"] == ["all numeric missing"]
    with pytest.raises(ValueError):
        contract.validate(df, ["absent"], {})


def design_frame(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = 2.0 + 1.5 * a - 0.7 * b + rng.normal(size=n) * (1 + np.abs(a))
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "alias": a - 2 * b, "const": 1.0, "y": y, "order_id": np.arange(n)})
    return spark.createDataFrame(pdf), pdf


def test_ols_and_hc3_match_dense_algebra(spark):
    df, pdf = design_frame(spark)
    rows = {r["term"]: r for r in stats.ols_inference(df, ["a", "b", "c"], "y")}
    x = np.column_stack([np.ones(len(pdf)), pdf[["a", "b", "c"]]])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ pdf["y"]
    e, h = pdf["y"] - x @ beta, np.einsum("ij,jk,ik->i", x, inv, x)
    cov = inv @ (x.T * (e / (1 - h)).to_numpy() ** 2) @ x @ inv
    for i, term in enumerate(["const", "a", "b", "c"]):
        assert np.isclose(rows[term]["coef"], beta[i]) and np.isclose(rows[term]["se"], np.sqrt(cov[i, i]))


def test_vif_and_elimination(spark):
    df, _ = design_frame(spark)
    g = stats.gram(df, ["a", "b", "c", "alias", "const"])
    v = stats.vif_of(g.covariance(g.columns))
    assert np.isinf(v[[0, 1, 3, 4]]).all() and v[2] < 1.1
    left, trace = stats.vif_elimination({"t": g}, {}, [])
    assert "const" not in left and trace[0]["stage"] == "constant" and len(left) == 3
    summary = stats.stage_summary(spark.createDataFrame([tuple(r.values()) for r in trace], stats.TRACE), 5).collect()
    assert [r["stage"] for r in summary] == ["start", *stats.STAGES] and summary[-1]["remaining"] == 3 and summary[1]["removed_columns"] == "const"


def test_forward_selection_finds_the_signal(spark):
    df, pdf = design_frame(spark, 2000)
    g = stats.gram(df, ["a", "b", "c", "y"])
    path = stats.forward_ic(g, {"a": ["a"], "b": ["b"], "c": ["c"]}, "y", "bic")
    assert [r["added_unit"] for r in path[1:3]] == ["a", "b"]
    half = [stats.gram(df.where(c), ["a", "b", "c", "y"]) for c in ("order_id < 1000", "order_id >= 1000")]
    units = {"a": ["a"], "b": ["b"], "c": ["c"]}
    cv = stats.forward_cv([(half[0], half[1], units), (half[1], half[0], units)], list(units), "y")
    x = lambda d: np.column_stack([np.ones(len(d)), d[["a", "b"]]])
    tr, va = pdf[pdf.order_id < 1000], pdf[pdf.order_id >= 1000]
    scores = [np.sqrt(((b["y"] - x(b) @ np.linalg.lstsq(x(a), a["y"], rcond=None)[0]) ** 2).mean()) for a, b in ((tr, va), (va, tr))]
    assert np.isclose(cv[2]["cv_mean"], np.mean(scores))
    steps = [(i, u, m, 0.02) for i, (u, m) in enumerate(zip("-abcd", [0.0, .1, .19, .2, .18]))]
    marked = stats.mark_one_se(spark.createDataFrame(steps, "step int, added_unit string, cv_mean double, cv_se double"), True)
    assert [(r.step, r.in_one_se_model, r.best_step) for r in marked.orderBy("step").collect()] == \
        [(0, False, False), (1, True, False), (2, True, False), (3, False, True), (4, False, False)]
    table = [tuple(r) for r in stats.selection_overlap(["d", "a", "b", "x"], marked, {"bic": ["a"], "lasso": ["a", "x"]}).collect()]
    assert table[0] == ("a", True, True, True, 1, 3) and table[1:] == [("b", True, False, False, 2, 1), ("x", False, False, True, None, 1), ("d", False, False, False, 4, 0)]


def test_resampling_counts(spark):
    df = spark.createDataFrame([(i, float(i % 5 == 0), float(i), "x" if i % 2 else "z") for i in range(100)], "order_id long, y double, v double, c string")
    assert {r["y"]: r["count"] for r in ml.undersample(df).groupBy("y").count().collect()} == {0.0: 20, 1.0: 20}
    assert {r["y"]: r["count"] for r in ml.oversample(df).groupBy("y").count().collect()} == {0.0: 80, 1.0: 80}
    made = ml.synthetic_minority(df, ["v"], ["c"])
    assert {r["y"]: r["count"] for r in made.groupBy("y").count().collect()} == {0.0: 80, 1.0: 80}
    lo, hi = made.where("order_id < 0").agg(F.min("v"), F.max("v")).first()
    assert 0 <= lo and hi <= 99
    moved = ml.shuffled(df, "v", 3)
    assert moved.count() == 100 and moved.agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0]
    assert moved.where(F.col("v") != F.col("order_id")).count() > 80


def test_search_goes_on_where_it_broke_off_and_ties_go_to_the_simpler_model(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, path = rng.integers(0, 10, 600), str(tmp_path / "scores")
    y = rng.random(600) < 0.1 + 0.06 * x
    rows = [(i, f, "valid" if i % 3 == f else "train", float(v), float(c), 20) for f in (1, 2) for i, (v, c) in enumerate(zip(x, y))]
    folds = spark.createDataFrame(rows, "order_id long, fold int, role string, a double, y double, promised_lead_days int").withColumn("label", F.col("y").cast("int"))
    tried = []

    def spec_of(c):
        def make():
            tried.append(c["maxDepth"])
            return ml.forest("classification", numTrees=3, impurity="gini", featureSubsetStrategy="all", maxDepth=c["maxDepth"])
        return ml.Spec("f", "classification", make, ["a"], weight=c["weight"])
    first = [{"maxDepth": 1, "weight": None}, {"maxDepth": 4, "weight": "balanced"}]
    ml.search(spec_of, first, folds, 2, path)
    assert sorted(tried) == [1, 1, 4, 4]
    found = ml.search(spec_of, [*first, {"maxDepth": 6, "weight": None}], folds, 2, path)
    assert sorted(tried) == [1, 1, 4, 4, 6, 6] and found.count() == 6
    table = ml.candidate_table(found, "maxDepth int, weight string").collect()
    assert {(r.maxDepth, r.weight) for r in table} == {(1, None), (4, "balanced"), (6, None)}
    direct = ml.cv_metrics([ml.Spec("d", "classification", spec_of(first[1]).estimator, ["a"], weight="balanced")], folds, 2).collect()
    assert next(r for r in table if r.maxDepth == 4).mean_score == pytest.approx(np.mean([r["avg_precision"] for r in direct]), rel=1e-9)
    tied = spark.createDataFrame([(8, 5, 0.50003), (4, 50, 0.5), (2, 50, 0.4)], "maxDepth int, minInstancesPerNode int, mean_score double")
    assert [r.maxDepth for r in ml.mark_best(tied, [F.col("maxDepth"), F.desc("minInstancesPerNode")]).where("best").collect()] == [4]
    near = ml.neighbour_grid({"a": [1, 2, 3, 4], "b": ["x", "y"]}, {"a": 3, "b": "x"}, ["a"], trees=[10])
    assert [c["a"] for c in near] == [2, 3, 4] and {c["b"] for c in near} == {"x"}


def test_lasso_path_meets_the_optimality_conditions_and_its_error(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) + [0, 5, 0, 0]
    y = 3 + x @ [2.0, -1.0, 0.3, 0.0] + rng.normal(size=200)
    frames = [spark.createDataFrame(pd.DataFrame(np.column_stack([x, y])[rows], columns=[*"abcd", "y"])) for rows in (slice(0, 120), slice(120, 200))]
    train, valid = (stats.gram(f, [*"abcd", "y"]) for f in frames)
    grid = stats.lasso_penalties(train, "abcd", "y")
    path = stats.lasso_path(train, "abcd", "y", grid)
    assert len(grid) == 100 and not path[0].any() and path[-1].all()
    xt, yt = x[:120] - x[:120].mean(0), y[:120] - y[:120].mean()
    for penalty, beta in zip(grid, path):
        slope = xt.T @ (yt - xt @ beta) / 120
        assert np.all(np.abs(slope) <= penalty + 1e-5) and np.allclose(slope[beta != 0], penalty * np.sign(beta[beta != 0]), atol=1e-5)
    guess = y[:120].mean() + (x[120:] - x[:120].mean(0)) @ path[50]
    assert stats.lasso_error(train, valid, "abcd", "y", path[50]) == pytest.approx(np.mean((y[120:] - guess) ** 2))


def test_model_queries_search_the_whole_space():
    from lanewise.operators import features
    from lanewise.plans import statistics_and_models as plans
    assert len(ml.grid(ml.TREE_SPACE)) == 160
    assert plans._forest_search.__defaults__ == (ml.FOREST_SPACE, 60, 200, (300, 500)) and plans.REPEATS == 5
    assert plans.tree_spec("classification").num_cols == features.SELECTED_NUMERIC and not hasattr(plans, "FEW")


def test_backtest_months_come_from_the_data(spark):
    from lanewise.plans.statistics_and_models import backtest_months
    rows = spark.sql("SELECT explode(sequence(timestamp'2001-01-15', timestamp'2002-06-20', interval 10 days)) AS approved_at UNION ALL SELECT NULL")
    assert backtest_months(rows) == ["2002-03", "2002-04", "2002-05", "2002-06"]
    assert backtest_months(rows.limit(0)) == []


def test_permutations_shared_by_features_give_the_same_importance(spark):
    df = spark.range(400).selectExpr("id AS order_id", "CAST(pmod(xxhash64(id), 100) AS DOUBLE) AS a", "CAST(pmod(xxhash64(id, 1), 100) AS DOUBLE) AS b",
                                     "CASE WHEN id % 3 = 0 THEN 'x' ELSE 'y' END AS c").selectExpr("*", "CAST(a + b / 4 > 70 AS DOUBLE) AS y")
    model = ml.fit(ml.Spec("m", "classification", lambda: ml.tree("classification", maxDepth=4), ["a", "b"], ["c"]), df)
    got = {r["feature"]: r for r in ml.permutation_importance(model, df, ["a", "b", "c"], repeats=2).collect()}

    def ap(rows):
        return metrics.classification_metrics(model.score(rows, ["order_id", "y"]).selectExpr("*", "CAST(y AS INT) AS label", "1 AS part"), ["part"]).first()["avg_precision"]
    assert got["a"]["rank"] == 1 and len(got) == 3
    assert got["b"]["importance_mean"] == pytest.approx(ap(df) - np.mean([ap(ml.shuffled(df, "b", s)) for s in (0, 1001)]))
