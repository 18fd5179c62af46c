import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanewise.operators import labels, splits

SCHEMA = "order_id string, approved_at timestamp_ntz, delivered_at timestamp_ntz, estimated_at timestamp_ntz, order_status string"


def ts(text):
    return dt.datetime.fromisoformat(text) if text else None


def orders(spark, rows):
    return spark.createDataFrame([(i, ts(a), ts(d), ts(e), "delivered") for i, a, d, e in rows], SCHEMA)


def test_label_boundaries(spark):
    df = orders(spark, [
        ("on_day", "2018-01-01", "2018-01-10T23:00", "2018-01-10"), ("late", "2018-01-01", "2018-01-11", "2018-01-10"),
        ("delivered_on_run_day", "2018-01-01", "2018-02-01", "2018-02-05"), ("overdue", "2018-01-01", None, "2018-01-31"),
        ("due_on_run_day", "2018-01-01", None, "2018-02-01"), ("reversed", "2018-01-05", "2018-01-04", "2018-01-10"),
        ("approved_on_run_day", "2018-02-01", None, "2018-01-15"), ("no_deadline", "2018-01-01", "2018-01-04", None)])
    got = {r.order_id: (r.label, r.label_status) for r in labels.labels_as_of(df, "2018-02-01").collect()}
    assert got == {
        "on_day": (0, "on_time_delivered"), "late": (1, "late_delivered"), "delivered_on_run_day": (None, "unresolved"),
        "overdue": (1, "late_undelivered"), "due_on_run_day": (None, "unresolved"), "reversed": (None, "invalid_or_missing_dates"),
        "approved_on_run_day": (None, "invalid_or_missing_dates"), "no_deadline": (None, "invalid_or_missing_dates")}


def test_capped_target(spark):
    df = orders(spark, [("slow", "2018-01-01", "2018-03-20", "2018-01-21"), ("open", "2018-01-01", None, "2018-01-21"),
                        ("early", "2018-01-01", "2018-01-11", "2018-01-21"), ("young", "2018-03-01", None, "2018-03-21")])
    got = {r.order_id: (r.target, r.target_status) for r in labels.targets_as_of(df, "2018-04-01", 45).collect()}
    assert got == {"slow": (25.0, "capped_delivered"), "open": (25.0, "capped_undelivered"),
                   "early": (-10.0, "delivered_within_waiting_period"), "young": (None, "unresolved")}


def test_labels_only_become_known(spark):
    df = orders(spark, [("a", "2018-01-01", "2018-01-20", "2018-01-10"), ("b", "2018-01-01", None, "2018-01-25"), ("c", "2018-01-03", "2018-01-09", "2018-01-30")])
    seen = {}
    for run in ("2018-01-05", "2018-01-12", "2018-01-21", "2018-02-10"):
        for r in labels.labels_as_of(df, run).collect():
            if r.order_id in seen and seen[r.order_id] is not None:
                assert r.label == seen[r.order_id]
            seen[r.order_id] = r.label
    assert seen == {"a": 1, "b": 1, "c": 0}


def test_run_date_as_column_equals_literal(spark):
    df = orders(spark, [("a", "2018-01-01", "2018-01-20", "2018-01-10"), ("b", "2018-01-05", None, "2018-01-25")])
    by_column = labels.labels_as_of(df.withColumn("run", F.lit("2018-01-15").cast("date")), F.col("run"))
    assert [r.label_status for r in by_column.orderBy("order_id").collect()] == \
           [r.label_status for r in labels.labels_as_of(df, "2018-01-15").orderBy("order_id").collect()]


def test_required_dates():
    assert [str(d) for d in labels.required_dates("2018-06-02", 45, 365)] == ["2017-04-18", "2018-04-17", "2018-06-01"]
    for bad in (("2018-6-2", 45, 180), (20180602, 45, 180), ("2018-06-02", True, 180), ("2018-06-02", -1, 180), ("2018-06-02", 45, 0)):
        with pytest.raises(ValueError):
            labels.required_dates(*bad)


def daily(spark, n, skip=(), copies=1):
    start = dt.datetime(2018, 1, 1)
    rows = [(f"{i}-{c}", start + dt.timedelta(days=i)) for i in range(n) if i not in skip for c in range(copies)]
    return spark.createDataFrame(rows, "order_id string, approved_at timestamp_ntz")


def test_holdout_with_gap(spark):
    got = {r["split"]: r["count"] for r in splits.chronological_split(daily(spark, 180), 45, 45).groupBy("split").count().collect()}
    assert got == {"train": 90, "test": 45, None: 45}
    with pytest.raises(ValueError):
        splits.chronological_split(daily(spark, 60), 45, 45)


def test_fixed_folds_with_a_missing_day(spark):
    df = daily(spark, 250, skip={120}, copies=2)
    plan = splits.fold_plan(splits.approval_days(df), n_splits=5, gap_days=10, validation_days=30)
    last = dt.date(2018, 1, 1) + dt.timedelta(days=249)
    assert plan[0]["valid_start"] == last - dt.timedelta(days=149)
    rows = splits.assign_folds(df, plan)
    first = rows.where("fold = 1 AND role = 'valid'").select(F.to_date("approved_at").alias("d")).distinct().count()
    assert first == 29
    for p in plan:
        train_end = rows.where((F.col("fold") == p["fold"]) & (F.col("role") == "train")).agg(F.max(F.to_date("approved_at"))).first()[0]
        assert (p["valid_start"] - train_end).days > 10


def test_equal_folds_follow_near_equal_cuts():
    days = [dt.date(2018, 1, 1) + dt.timedelta(days=i) for i in range(20)]
    plan = splits.fold_plan(days, n_splits=5)
    assert [(p["valid_end"] - p["valid_start"]).days + 1 for p in plan] == [4, 3, 3, 3, 3]
    for bad in (dict(n_splits=1), dict(n_splits=5, gap_days=-1), dict(n_splits=5, validation_days=0), dict(n_splits=5, validation_days=30),
                dict(n_splits=3, validation_days=2, min_train_days=3)):
        with pytest.raises(ValueError):
            splits.fold_plan(days, **bad)


def test_availability_filter(spark):
    df = spark.createDataFrame([
        ("0", ts("2018-01-01"), ts("2018-01-20"), ts("2018-01-30"), "delivered", 0.0), ("1", ts("2018-02-01"), ts("2018-03-05"), ts("2018-03-20"), "delivered", 0.0),
        ("2", ts("2018-01-02"), None, ts("2018-02-01"), "shipped", 1.0), ("3", ts("2018-02-20"), None, ts("2018-03-15"), "shipped", 1.0)], SCHEMA + ", y double")
    kept = splits.available_training_rows(df, dt.date(2018, 3, 1), labels.labels_as_of, "label")
    assert sorted(r.order_id for r in kept.collect()) == ["0", "2"]


@pytest.mark.parametrize("audit, known", [(labels.labels_as_of, "label"), (lambda df, run: labels.targets_as_of(df, run, 45), "target")])
def test_known_outcomes_stay_beside_their_rows(spark, audit, known):
    start, at = dt.date(2018, 3, 1), lambda d: dt.datetime(2018, 1, 1) + dt.timedelta(days=d)
    rows = [(1, at(0), at(10), at(20), 7), (2, at(0), at(30), at(20), 8), (3, at(0), at(70), at(80), 9), (None, at(0), at(10), at(20), 7), (4, at(1), None, at(20), 7)]
    make = lambda some: spark.createDataFrame(some, "order_id long, approved_at timestamp_ntz, delivered_at timestamp_ntz, estimated_at timestamp_ntz, label int")

    def joined(df):
        return df.join(audit(df, start).select("order_id", F.col(known).alias("_seen")), "order_id")
    once, twice = make(rows), make([*rows, (1, at(0), at(25), at(20), 7)])
    for df in (once, twice):
        got = splits.known_outcomes(df, start, audit, known)
        assert got.columns == joined(df).columns and sorted(map(str, got.collect())) == sorted(map(str, joined(df).collect()))
    assert "Join" not in splits.known_outcomes(once, start, audit, known)._jdf.queryExecution().optimizedPlan().toString()
