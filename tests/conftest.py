import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from attestra.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over a single row of named string values."""
    from pyspark.sql import functions as F

    def run(column, **values):
        schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}"
                           for k, v in values.items()) or "x string"
        row = tuple(values.values()) or ("",)
        return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]

    run.F = F
    return run
