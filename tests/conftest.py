from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    from colonnade import session

    work = tmp_path_factory.mktemp("work")
    started = session.start(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{work}", "spark.sql.warehouse.dir": str(work / "warehouse")}
    )
    started.sparkContext.setLogLevel("OFF")
    yield started
    started.stop()
