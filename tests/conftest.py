import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from keelson.session import build_session

    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = build_session("tests", "local[8]", **{
        "spark_sql_shuffle_partitions": "8", "spark_ui_enabled": "false", "spark_ui_showConsoleProgress": "false",
        "spark_sql_warehouse_dir": warehouse, "spark_driver_memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
