from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]")
        .appName("covlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="covlens-warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="covlens-tests-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lives_small(spark):
    from covlens.sources.fixtures import lives_table

    return lives_table(spark, SMALL)


@pytest.fixture(scope="session")
def lives_medium(spark):
    from covlens.sources.fixtures import lives_table

    return lives_table(spark, MEDIUM)


def lives_rows(spark, rows):
    """A lives DataFrame from literal rows given as dicts (missing columns NULL)."""
    from covlens.sources.schemas import LIVES_SCHEMA

    full = [tuple(r.get(f.name) for f in LIVES_SCHEMA.fields) for r in rows]
    return spark.createDataFrame(full, LIVES_SCHEMA)
