"""Every query with SQL against DuckDB on the smallest tables; the others must return rows."""
import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = os.environ.get("LANEWISE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Rows-only queries run here without the ones that fit many models; LANEWISE_ALL=1 runs them too.
QUICK = {"table_fingerprint", "sample_one_per_day", "subsample_rows", "random_stratified_split", "design_vif", "ols_inference",
         "forward_ic_stepwise", "gbt_model", "resample_under", "resample_over", "resample_smotenc", "bulk_score", "model_size"}


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    difference, _ = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert difference is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_returns_rows(spark, con, name):
    if name not in QUICK and not os.environ.get("LANEWISE_ALL"):
        pytest.skip("many model fits; set LANEWISE_ALL=1")
    difference, rows = compare(spark, con, QUERIES[name], None, SF)
    assert difference is None and rows > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["month", "orders", "late_rate"]


def test_imports_without_a_session():
    """The driver reads the catalogue before it starts Spark."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
