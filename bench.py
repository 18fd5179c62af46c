"""Headline timings: one JSON line on stdout."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lanewise.plans import load_catalog  # noqa: E402
from lanewise.session import make_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["late_rate_as_known", "feature_table", "order_outcome_table", "asof_seller_history", "entity_history_smoothed",
            "seller_distance_stats", "payment_pivot", "table_inventory", "referential_integrity", "buffer_label_audit",
            "waiting_period_audit", "monthly_late_rate", "repeat_purchase_monthly", "classification_metrics", "risk_deciles",
            "build_worklist", "month_summary", "effort_curve", "available_outcome_folds", "vif_elimination", "linear_model"]


def main() -> None:
    spark = make_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_catalog()
    spark.read.parquet(f"{SF_DIR}/nation.parquet").groupBy("n_regionkey").count().collect()  # start-up cost is not a query
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
