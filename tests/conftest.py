import os

os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)

import pytest

from leadloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", 4, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    return s
