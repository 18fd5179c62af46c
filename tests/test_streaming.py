import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lanewise.plans import load_catalog
from lanewise.streaming import streams

SF = "/root/testdata/sf0.001"


def at(s):
    return dt.datetime.fromisoformat(s + "T00:00:00+00:00")


def test_labels_over_several_batches(spark, tmp_path):
    """Approval and delivery may arrive in different batches; each order is emitted once."""
    schema = "order_id long, event_ts timestamp, kind string, deadline date"
    due = dt.date(2018, 1, 20)
    first = [(1, at("2018-01-01"), "approved", due), (2, at("2018-01-01"), "approved", due), (3, at("2018-01-02"), "approved", dt.date(2018, 3, 30)), (4, at("2018-01-03"), "approved", due)]
    second = [(1, at("2018-01-15"), "delivered", due), (4, at("2018-01-25"), "delivered", due)]
    third = [(9, at("2018-04-01"), "approved", due)]
    for i, rows in enumerate((third, second, first)):  # the newest arrive first
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.order_id: (r.label, r.label_status) for r in streams.label_maturity(src, 45).collect()}
    assert got == {1: (0, "on_time_delivered"), 4: (1, "late_delivered"), 2: (1, "late_undelivered"), 3: (None, "unresolved")}


@pytest.mark.parametrize("name, tables", [("stream_daily_counts", ["orders"]), ("stream_monitor", ["lineitem", "orders"]), ("stream_label_maturity", ["orders"])])
def test_many_files_in_random_order_give_the_batch_answer(spark, tmp_path, monkeypatch, name, tables):
    """Each table as a folder of files, one per batch, rows in random order."""
    from conftest import link_tables
    folder = link_tables(tmp_path, SF, tables)
    for t in tables:
        spark.read.parquet(f"{SF}/{t}.parquet").orderBy(F.rand(3)).repartition(5).write.parquet(f"{folder}/{t}.parquet")
    real = streams.read_stream
    monkeypatch.setattr(streams, "read_stream", lambda s, f, n: real(s, f, n, files_per_batch=1))
    query = load_catalog()[0][name]
    want = sorted(map(tuple, query(spark, SF).collect()), key=str)
    assert len(want) > 1 and sorted(map(tuple, query(spark, folder).collect()), key=str) == want


def test_a_later_run_continues(spark, tmp_path):
    random.seed(1)
    folders = {"out": str(tmp_path / "out"), "progress": str(tmp_path / "progress")}
    for part in range(3):
        rows = [(at(f"2018-01-{random.randint(1, 28):02d}"),) for _ in range(50)]
        spark.createDataFrame(rows, "ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))
        got = streams.daily_counts(src, "ts", **folders)
        assert got.groupBy().sum("orders").first()[0] == 50 * (part + 1)
    assert len(list((tmp_path / "out").glob("epoch=*"))) == 3
