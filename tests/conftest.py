import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from frameloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("frameloom-tests", cores="8", partitions=8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def table(spark):
    """Small literal tables: table("a int, b string", [(1, "x")])."""

    def make(schema, rows):
        return spark.createDataFrame(rows, schema)

    return make
