"""Trees keep their leaves' rates, and cuts of a deep tree equal trees fitted with a depth limit."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lanewise.operators import ml, trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 10, (4_000, 2)).astype(float)
    y = (rng.random(4_000) < 0.01 + 0.03 * x[:, 0]).astype(float)
    df = spark.createDataFrame([(int(i), float(a), float(b), float(c), float(a + c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "order_id long, a double, b double, y double, days double")
    return df.repartition(4).cache()


@pytest.mark.parametrize("make", [lambda: ml.tree("classification", maxDepth=9, minInstancesPerNode=1, impurity="gini"),
                                  lambda: ml.forest("classification", maxDepth=9, minInstancesPerNode=1, impurity="gini", numTrees=5, featureSubsetStrategy="all")])
def test_rare_outcomes_keep_their_rates(rows, make):
    fitted = ml.fit(ml.Spec("t", "classification", make, ["a"]), rows)
    got = {r.a: r.p for r in fitted.score(rows, ["a"]).distinct().collect()}
    rate = {r.a: r.p for r in rows.groupBy("a").agg(F.avg("y").alias("p")).collect()}
    assert len(set(got.values())) == 10 and all(abs(got[a] - rate[a]) < 0.05 for a in rate)


def test_leaves_of_printed_rules():
    text = "header\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.5)\n    Predict: 0.1\n   Else (feature 1 > 2.5)\n    Predict: 0.2\n  Else (feature 0 > 1.5)\n   Predict: 0.3\n"
    leaves = trees.leaves_of(text)
    assert leaves.depth.tolist() == [2, 2, 1] and [leaves.count(d) for d in (0, 1, 2, 9)] == [1, 2, 3, 3]
    assert trees.leaves_of("header\n  Predict: 0.5\n").count(5) == 1


def test_stored_nodes_give_the_printed_leaves(spark, rows, monkeypatch):
    spec = ml.Spec("t", "regression", lambda: ml.tree("regression", maxDepth=30, minInstancesPerNode=1), ["a", "b"])
    one = ml.Spec("t", "regression", lambda: ml.tree("regression", maxDepth=30, minInstancesPerNode=4_000), ["a", "b"])
    for s in (spec, one):
        model = ml.fit(s, rows).model
        got, printed = trees.model_leaves(spark, model), trees.leaves_of(model.toDebugString)
        assert len(got.leaf) == ml.model_size(model) and got.depth.tolist() == printed.depth.tolist()
        assert all((got.cut(d) == printed.cut(d)).all() for d in (0, 1, 2, 5, 30))
    # The rules of a deep tree are never printed: they take about a kilobyte a leaf on the driver.
    monkeypatch.setattr(trees, "leaves_of", None)
    found, counts = trees.deep_trees(lambda **p: ml.Spec("t", "regression", lambda: ml.tree("regression", **p), ["a", "b"]), [{"minInstancesPerNode": 1, "impurity": "variance"}], rows, None, 0)
    assert found[0].model is None and counts.num_rows == len(found[0].leaves.leaf) and sum(counts["n"].to_pylist()) == 4_000


@pytest.mark.parametrize("task,label", [("classification", "y"), ("regression", "days")])
def test_cuts_equal_direct_fits(rows, task, label):
    df = rows.withColumn("y", F.col(label))
    fold = F.when(F.col("order_id") % 4 == 0, "valid").otherwise("train")
    folds = df.withColumn("fold", F.lit(1)).withColumn("role", fold).unionByName(df.withColumn("fold", F.lit(2)).withColumn(
        "role", F.when(F.col("order_id") % 4 == 1, "valid").otherwise("train")))
    spec_of = lambda **p: ml.Spec("t", task, lambda: ml.tree(task, **p), ["a", "b"])
    space = {"maxDepth": [1, 3, 6], "minInstancesPerNode": [1, 60], "impurity": ["gini" if task == "classification" else "variance"]}
    found = trees.grid_search(spec_of, space, df, folds, 2, task)
    assert len(found) == 6 and sum(r["best"] for r in found) == 1
    for r in found:
        params = {k: r[k] for k in space}
        scores = []
        for i in (1, 2):
            train, valid = ml.fold_parts(folds, i)
            fitted = ml.fit(spec_of(**params), train)
            scored = fitted.score(valid, ["y"]).toPandas()
            p, y = scored.iloc[:, 1].to_numpy(), scored["y"].to_numpy()
            if task == "regression":
                scores.append(-np.sqrt(np.mean((p - y) ** 2)))
            else:
                cuts = np.unique(np.round(p, 12))[::-1]
                hits = np.array([y[np.round(p, 12) >= c].sum() for c in cuts])
                n = np.array([(np.round(p, 12) >= c).sum() for c in cuts])
                scores.append((np.diff(np.append(0, hits)) * hits / n).sum() / y.sum())
        assert r["mean_score"] == pytest.approx(np.mean(scores), rel=1e-9)
        whole = ml.fit(spec_of(**params), df).model
        assert r["n_leaves"] == ml.model_size(whole)


def test_entropy_trees_share_the_pass(rows):
    folds = rows.withColumn("fold", F.lit(1)).withColumn("role", F.when(F.col("order_id") % 4 == 0, "valid").otherwise("train"))
    spec_of = lambda **p: ml.Spec("t", "classification", lambda: ml.tree("classification", **p), ["a", "b"])
    found = trees.grid_search(spec_of, {"maxDepth": [2, 5], "minInstancesPerNode": [1, 50], "impurity": ["gini", "entropy"]}, rows, folds, 1, "classification")
    assert len(found) == 8 and all(0 < r["mean_score"] <= 1 and r["n_leaves"] >= 1 for r in found)


def test_partial_dependence_equals_scoring_each_value(rows):
    df = rows.where("order_id < 300").withColumn("c", F.when(F.col("order_id") % 3 == 0, "x").otherwise("z"))
    fitted = ml.fit(ml.Spec("t", "classification", lambda: ml.tree("classification", maxDepth=5, minInstancesPerNode=1), ["a", "b"], ["c"]), df)
    grids = ml.dependence_grids(df.withColumn("wide", F.col("order_id").cast("double")), ["a", "wide"], ["c"])
    assert grids["a"] == [float(i) for i in range(10)] and grids["c"] == ["x", "z"]
    assert len(grids["wide"]) == 20 and grids["wide"][0] == pytest.approx(299 * 0.05) and grids["wide"][-1] == pytest.approx(299 * 0.95)
    got = {(r.feature, r.value): r.average for r in ml.partial_dependence(fitted, df, {"a": grids["a"], "c": grids["c"]}).collect()}
    assert len(got) == 12
    for (feature, value), average in got.items():
        fixed = df.withColumn(feature, F.lit(value) if feature == "c" else F.lit(float(value)))
        assert average == pytest.approx(fitted.score(fixed, ["order_id"]).agg(F.avg("p")).first()[0], rel=1e-12)


def test_few_files_are_dealt_over_the_cores(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "id % 3 AS y").coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    made = ml.dealt(one)
    sizes = [r[0] for r in made.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    assert made.agg(F.count("*"), F.sum("id"), F.sum("y")).first() == one.agg(F.count("*"), F.sum("id"), F.sum("y")).first()
    few = one.where("id < 100")
    assert ml.dealt(few) is few and ml.dealt(few, 100) is not few


def test_held_nodes_leave_the_forest_as_it_is(rows, monkeypatch):
    df = rows.where("order_id < 900").withColumn("y", F.col("days"))
    spec = ml.Spec("f", "regression", lambda: ml.forest("regression", maxDepth=6, minInstancesPerNode=2, numTrees=7, featureSubsetStrategy="sqrt", subsamplingRate=0.5), ["a", "b"])
    held = ml.fit(spec, df).model
    assert held.getCacheNodeIds() and held.getMaxMemoryInMB() == 512
    monkeypatch.setattr(ml, "FOREST_PASSES", {})
    assert ml.fit(spec, df).model.toDebugString.splitlines()[1:] == held.toDebugString.splitlines()[1:]


def test_inference_encodes_its_rows_once(spark, rows):
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v
    slow = F.udf(seen, "double")
    found, _ = ml.logit_inference(rows.where("order_id < 500").select("y", slow("a").alias("a"), "b"), ["a", "b"], "y")
    assert [r["term"] for r in found] == ["a", "b", "const"] and 500 <= read.value <= 1000
