import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from lanewise.session import make_session
    s = make_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                             "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def link_tables(folder, source, without):
    """A folder with links to all tables of `source` but those named."""
    for f in os.listdir(source):
        if f.removesuffix(".parquet") not in without:
            os.symlink(os.path.join(source, f), os.path.join(folder, f))
    return str(folder)
