"""Missing group keys, scores that are no numbers, repeated lookups, rows without dates."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanewise.operators import contract, joins, metrics, policy, splits

NAN = float("nan")


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, g, (i % 10) / 10 if i % 7 else NAN, int(i % 3 == 0), float(i), float(i + (i % 5) - 2)) for i, g in enumerate(["a", None] * 30)]
    return spark.createDataFrame(rows, "order_id long, g string, p double, label int, target double, days double")


def test_a_missing_key_is_a_group(scored):
    got = {r.g: r.n_scored for r in metrics.classification_metrics(scored, ["g"]).collect()}
    assert set(got) == {"a", None} and sum(got.values()) == scored.where(~F.isnan("p")).count()
    errors = {r.g: r for r in metrics.regression_metrics(scored, ["g"]).collect()}
    assert {k: v.n for k, v in errors.items()} == {"a": 30, None: 30} and all(v.median_ae == 1.0 for v in errors.values())
    assert {r.g for r in metrics.regression_split_metrics(scored, ["g"]).collect()} == {"a", None}


def test_no_number_is_no_score(scored):
    whole = metrics.classification_metrics(scored).first()
    clean = metrics.classification_metrics(scored.where(~F.isnan("p"))).first()
    # Sums of doubles may differ in the last digit from run to run.
    assert list(whole) == pytest.approx(list(clean), rel=1e-12) and whole.n_scored == 51
    assert metrics.risk_deciles(scored).agg(F.sum("scored_orders")).first()[0] == 51
    with_nan = scored.withColumn("days", F.when(F.col("order_id") < 4, F.lit(NAN)).otherwise(F.col("days")))
    assert metrics.regression_metrics(with_nan).first().n == 56


def test_worklist_sets_aside_scores_that_are_no_numbers(spark):
    t = dt.datetime(2018, 1, 1, 10)
    orders = spark.createDataFrame([(i, t, None, t + dt.timedelta(days=20)) for i in range(3)], "order_id long, approved_at timestamp_ntz, delivered_at timestamp_ntz, estimated_at timestamp_ntz")
    scores = spark.createDataFrame([(0, NAN), (1, 0.2), (2, float("inf"))], "order_id long, p double")
    got = {r.order_id: (r["rank"], r.reasons) for r in policy.worklist(orders, scores, min_days=5).collect()}
    assert got == {0: (None, ["invalid_model_inputs"]), 1: (1, []), 2: (None, ["invalid_model_inputs"])}


def test_a_repeated_lookup_key_is_refused(spark):
    rows, look = spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([(0, "x"), (1, "y"), (1, "z")], "k long, v string")
    assert joins.map_lookup(rows, look.where("k = 0"), "k", "v").where("v = 'x'").count() == 1
    with pytest.raises(Exception, match="repeats"):
        joins.map_lookup(rows, look, "k", "v").collect()


def test_unknown_features_are_refused():
    contract.require_features(["a"], ["a", "b"])
    with pytest.raises(ValueError, match="c"):
        contract.require_features(["a", "c"], ["a", "b"])


def test_scoring_refuses_unknown_columns(spark):
    rows = spark.range(2).selectExpr("id AS order_id", "CAST(id + 1 AS DOUBLE) AS order_item_count", "'x' AS customer_state")
    checked = contract.validate(rows, ["order_item_count"], {"customer_state": ["x"]}, others=["order_id"])
    assert [r.violations for r in checked.collect()] == [[], []]
    with pytest.raises(ValueError, match="tip"):
        contract.validate(rows.withColumn("tip", F.lit(1.0)), ["order_item_count"], {"customer_state": ["x"]}, others=["order_id"])


def test_split_refuses_rows_without_a_day(spark):
    days = [(dt.datetime(2018, 1, 1) + dt.timedelta(days=i),) for i in range(90)]
    with pytest.raises(ValueError, match="without an approval day"):
        splits.chronological_split(spark.createDataFrame([*days, (None,)], "approved_at timestamp_ntz"), 30, 10)
