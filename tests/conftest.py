from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('work')}").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from papyrine.worktable import release

    release(session)


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over literal columns."""
    def value(make, **columns):
        from pyspark.sql import functions as F

        rows = spark.range(1).select(*(F.lit(v).alias(k) if not hasattr(v, "alias") else v.alias(k) for k, v in columns.items()))
        return rows.select(make(*(F.col(k) for k in columns)).alias("v")).first()["v"]

    return value
