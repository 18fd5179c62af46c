"""Neighbour search against brute force; synthetic rows stay between their parents."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise.operators import ml, neighbours


def table(n, d, seed=3, copies=0):
    """Numbers of unequal scale around 15 centres, a level tied to the centre, and ``copies`` equal rows."""
    rng = np.random.default_rng(seed)
    at = rng.integers(0, 15, n)
    x = (rng.normal(size=(15, d)) * 3)[at] + rng.normal(size=(n, d)) * np.linspace(0.2, 2, d)
    level = np.where(rng.random(n) < 0.7, at % 4, rng.integers(0, 4, n))
    x[:copies], level[:copies] = x[0], level[0]
    return pd.DataFrame({"key": rng.permutation(n), **{f"x{i}": x[:, i] for i in range(d)}, "lev": [None if l == 3 else f"l{l}" for l in level]})


def brute(pdf, d, mismatch, k):
    x, lev = pdf[[f"x{i}" for i in range(d)]].to_numpy(), pdf["lev"].fillna("").to_numpy()
    far = np.array([((x - x[i]) ** 2).sum(1) + mismatch * (lev != lev[i]) for i in range(len(pdf))])
    np.fill_diagonal(far, np.inf)
    return far, np.sort(far, axis=1)[:, k - 1]


@pytest.mark.parametrize("n,d,leaf,copies", [(4000, 8, 128, 0), (3000, 5, 64, 1000), (3000, 15, 256, 0)])
def test_recall(spark, n, d, leaf, copies):
    pdf = table(n, d, copies=copies)
    got = neighbours.nearest(spark.createDataFrame(pdf), "key", [f"x{i}" for i in range(d)], ["lev"], 1.5, 5, leaf=leaf).toPandas()
    assert sorted(got["id"]) == list(range(n)) and got["near"].map(len).eq(5).all()
    far, kth = brute(pdf, d, 1.5, 5)
    place = {key: i for i, key in enumerate(pdf["key"])}
    hits = [far[place[i], place[o]] <= kth[place[i]] + 1e-9 for i, near in zip(got["id"], got["near"]) for o in near]
    print("recall", np.mean(hits))
    assert np.mean(hits) >= 0.9
    assert all(i not in near and len(set(near)) == 5 for i, near in zip(got["id"], got["near"]))


def test_small_tables(spark):
    one = spark.createDataFrame([(1, 2.0, None)], "key long, a double, b string")
    assert [tuple(r) for r in neighbours.nearest(one, "key", ["a"], ["b"], 1.0).collect()] == [(1, [])]
    assert neighbours.nearest(one.limit(0), "key", ["a"], ["b"], 1.0).count() == 0
    two = one.union(one.withColumn("key", F.col("key") + 1))
    assert {r["id"]: r["near"] for r in neighbours.nearest(two, "key", [], ["b"], 1.0).collect()} == {1: [2], 2: [1]}


def test_synthetic_rows(spark):
    """0/1 columns stay 0 or 1, levels come from the neighbours, numbers from between the minority's."""
    rng = np.random.default_rng(8)
    rows = [(i, 1.0 if i < 60 else 0.0, float(rng.normal() + (5 if i < 60 else 0)) if i % 9 else None, float(i % 2), "near" if i < 60 else "far") for i in range(400)]
    df = spark.createDataFrame(rows, "order_id long, y double, a double, flag double, lev string")
    made = ml.synthetic_minority(df, ["a", "flag"], ["lev"]).toPandas()
    assert made.groupby("y").size().to_dict() == {0.0: 340, 1.0: 340} and made["order_id"].is_unique
    new = made[made["order_id"] < 0]
    assert len(new) == 280 and set(new["flag"]) <= {0.0, 1.0} and set(new["lev"]) == {"near"} and (new["y"] == 1).all()
    old = [r[2] for r in rows[:60] if r[2] is not None]
    mid = float(np.median([r[2] for r in rows if r[2] is not None]))
    assert new["a"].between(min(old + [mid]) - 1e-9, max(old) + 1e-9).all() and new["a"].round(9).nunique() > 200


def test_synthetic_from_one_row_and_from_one_class(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, None), (2, 0.0, 1.0, "x"), (3, 0.0, 0.5, "x")], "order_id long, y double, a double, lev string")
    new = ml.synthetic_minority(df, ["a"], ["lev"]).where("order_id < 0").collect()
    assert [(r["y"], r["a"], r["lev"]) for r in new] == [(1.0, 2.0, None)]
    assert ml.synthetic_minority(df.where("y = 0"), ["a"], ["lev"]).count() == 2


def test_resampling_summary_pairs_the_folds(spark):
    """Gains over no resampling by hand: fold scores of 1.0 against 0.5 and 1.0, and a Validation row of its own."""
    def fold(strategy, f, p):
        return [("C1", strategy, f, i, y, s) for i, (y, s) in enumerate(zip((1.0, 0.0, 0.0), p))]
    rows = fold("none", 1, (0.5, 0.9, 0.1)) + fold("none", 2, (0.9, 0.2, 0.1)) + fold("none", 0, (0.2, 0.3, 0.4)) \
        + fold("over", 1, (0.9, 0.5, 0.1)) + fold("over", 2, (0.8, 0.2, 0.1)) + fold("over", 0, (0.4, 0.3, 0.2))
    got = {r["strategy"]: r for r in ml.resampling_summary(spark.createDataFrame(rows, "model string, strategy string, fold int, order_id int, y double, p double")).collect()}
    none, over = got["none"], got["over"]
    assert np.isclose(none["cv_avg_precision_mean"], 0.75) and none["ap_gain_vs_none"] == 0 and not none["clear_ap_gain"]
    assert np.isclose(over["ap_gain_vs_none"], 0.25) and np.isclose(over["ap_gain_se"], 0.25) and not over["clear_ap_gain"]
    assert np.isclose(none["val_avg_precision"], 1 / 3) and np.isclose(over["val_avg_precision"], 1) and np.isclose(over["val_mean_probability"], 0.3)
