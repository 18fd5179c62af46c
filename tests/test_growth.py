"""Trees that grow together are those of pyspark.ml, leaf by leaf, whether a task or all of them hold a node's rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import growth, ml, trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 3_000
    a, b, c = rng.normal(size=n), np.where(rng.random(n) < 0.6, 0.0, rng.integers(-9, 60, n)), rng.integers(0, 4, n)
    y = (rng.random(n) < 1 / (1 + np.exp(2 - a - (b > 20) + 0.5 * c))).astype(float)
    made = [(i, float(a[i]), float(b[i]), float(c[i]), 7.0, "uvw"[i % 3], float(y[i])) for i in range(n)]
    return spark.createDataFrame(made, "order_id long, a double, b double, c double, same double, s string, y double").repartition(3).cache()


def direct_leaves(spec, rows):
    """(rows, sum of y) of every leaf of a tree that pyspark.ml fits by itself."""
    design = ml.build_design(spec, rows)
    vectors = ml.vectorise(design, rows, ["y"])
    model = ml.fit_vectors(spec, design, vectors).model
    at = model.setLeafCol("leaf").transform(vectors)
    return sorted((r.n, r.t) for r in at.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("y").alias("t")).collect()), trees.model_leaves(rows.sparkSession, model)


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_grown_together_equal_single_fits(rows, monkeypatch, task):
    df = rows if task == "classification" else rows.withColumn("y", F.round(F.col("a") * 4 + F.col("c") * F.col("y")))
    spec_of = lambda **p: ml.Spec("t", task, lambda: ml.tree(task, **p), ["a", "b", "c", "same"], ["s"])
    grid = [{"minInstancesPerNode": m, "impurity": i} for m in (1, 7, 200) for i in (("gini", "entropy") if task == "classification" else ("variance",))]
    found = {}
    for size in (100_000, 300):  # one task for all rows; or levels over all rows until a task may take a branch
        monkeypatch.setattr(growth, "PART_ROWS", size)
        found[size] = trees.deep_trees(spec_of, grid, df, df.where("order_id < 500"), 1)
    for i, g in enumerate(grid):
        leaves, model = direct_leaves(spec_of(maxDepth=trees.DEEPEST, **g), df)
        for made, counts in found.values():
            some = counts.filter(np.asarray(counts["tree"]) == i).to_pandas()
            known, asked = some[~some.valid], some[some.valid]
            assert sorted(zip(known.n, known.total)) == leaves, g
            assert sorted(made[i].leaves.depth) == sorted(model.depth) and [made[i].leaves.count(d) for d in (0, 1, 3, 6)] == [model.count(d) for d in (0, 1, 3, 6)]
            assert asked.n.sum() == 500 and asked.total.sum() == df.where("order_id < 500").agg(F.sum("y")).first()[0]


def test_candidate_splits_at_even_steps():
    assert growth.thresholds(np.array([0.0, 1, 1, 3]), 4, 32).tolist() == [0.5, 2.0]
    assert growth.thresholds(np.zeros(5), 5, 32).tolist() == [] and growth.thresholds(np.full(5, 2.0), 5, 32).tolist() == []
    steps = growth.thresholds(np.arange(1, 101, dtype=float), 100, 4)
    assert steps.tolist() == [25.5, 50.5, 75.5]


def test_grid_fits_no_tree_by_itself(rows, monkeypatch):
    """A fit a tree took 96 of them, each over all rows level by level: the grid ran out of time."""
    from pyspark.ml.base import Estimator
    fits = []
    fit = Estimator.fit
    monkeypatch.setattr(Estimator, "fit", lambda self, *a, **k: fits.append(self) or fit(self, *a, **k))
    folds = rows.withColumn("fold", F.lit(1)).withColumn("role", F.when(F.col("order_id") % 4 == 0, "valid").otherwise("train"))
    spec_of = lambda **p: ml.Spec("t", "classification", lambda: ml.tree("classification", **p), ["a", "b"])
    found = trees.grid_search(spec_of, {"maxDepth": [2, 5], "minInstancesPerNode": [1, 50], "impurity": ["gini", "entropy"]}, rows, folds, 1, "classification")
    assert len(found) == 8 and not fits
