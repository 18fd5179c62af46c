"""Command-line check: python tests/run_checks.py <sf_dir> [name ...]"""
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from lanewise.session import make_session  # noqa: E402
from compare import compare, duck  # noqa: E402


def main():
    sf, names = sys.argv[1], sys.argv[2:]
    spark = make_session("checks", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = duck(sf), entry.queries(), entry.oracle_sql()
    todo = []
    for n in names or qs:
        todo += [q for q in qs if q.startswith(n[:-1])] if n.endswith("*") else [n]
    bad = 0
    for name in todo:
        t = time.time()
        try:
            diff, n = compare(spark, con, qs[name], sqls.get(name), sf)
        except Exception as e:
            diff, n = f"ERROR {type(e).__name__}: {str(e)[:700]}", 0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += diff is not None
        print(f"{'OK ' if diff is None else 'BAD'} {name:34s} {n:7d} rows {time.time() - t:6.2f}s "
              f"{'' if name in sqls else '(rows only) '}{diff or ''}", flush=True)
    print(f"{len(todo)} checked, {bad} bad")


main()
