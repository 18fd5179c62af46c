"""Rows walked again for one changed feature score as the whole forest scores them, and no row is copied for a feature or value."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import metrics, ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=700), rng.integers(0, 9, 700)
    y = (a + 0.2 * b + rng.normal(size=700) > 1.5).astype(float)
    made = [(i, float(a[i]), None if i % 50 == 0 else float(b[i]), "uvwx"[i % 4] if i % 30 else None, i % 31, float(y[i])) for i in range(700)]
    return spark.createDataFrame(made, "order_id long, a double, b double, s string, days int, y double").repartition(3).cache()


@pytest.fixture(scope="module")
def forest(rows):
    return ml.fit(ml.Spec("f", "classification", lambda: ml.forest("classification", numTrees=12, maxDepth=7, minInstancesPerNode=2, impurity="gini",
                                                                   featureSubsetStrategy="sqrt", subsamplingRate=0.7), ["a", "b", "days"], ["s"]), rows)


def test_dependence_of_a_forest(rows, forest, monkeypatch):
    grids = {"a": [float(v) for v in np.linspace(-2, 2, 70)], "s": ["u", "v", "w", "x"], "days": [3.9, 4.1, 20.6]}
    with monkeypatch.context() as m:  # the model scored the rows once for every value
        m.setattr(ml.Fitted, "score_vectors", None)
        got = {(r.feature, r.value): r.average for r in ml.partial_dependence(forest, rows, grids).collect()}
    assert len(got) == 77
    for feature, value in [("a", v) for v in grids["a"][::23]] + [(c, v) for c in ("s", "days") for v in grids[c]]:
        fixed = rows.withColumn(feature, F.lit(value))
        assert got[feature, str(value)] == pytest.approx(forest.score(fixed, ["order_id"]).agg(F.avg("p")).first()[0], rel=1e-12)


def test_permutations_of_a_forest(rows, forest, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(ml.Fitted, "score_vectors", None)
        got = {r["feature"]: r for r in ml.permutation_importance(forest, rows, ["a", "b", "s"], repeats=2).collect()}

    def ap(some):
        return metrics.classification_metrics(forest.score(some, ["order_id", "y"]).selectExpr("*", "CAST(y AS INT) AS label", "1 AS part"), ["part"]).first()["avg_precision"]
    for c in ("b", "s"):
        assert got[c]["importance_mean"] == pytest.approx(ap(rows) - np.mean([ap(ml.shuffled(rows, c, s)) for s in (0, 1001)]))
