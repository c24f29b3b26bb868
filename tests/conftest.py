import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    compiled = "true" if os.environ.get("QUERNEL_TEST_CODEGEN") else "false"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        # Tables here are tiny: compiling code for them takes longer than running plans uncompiled. QUERNEL_TEST_CODEGEN=1 compiles.
        .config("spark.sql.codegen.wholeStage", compiled)
        .config("spark.sql.codegen.factoryMode", "FALLBACK" if compiled == "true" else "NO_CODEGEN")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session", autouse=True)
def few_buckets():
    """Small tables in few folders."""
    from quernel.operators import index

    index.BUCKETS = 4
