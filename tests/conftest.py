from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from lapframe.session import get_session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
