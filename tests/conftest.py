import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from barline.session import local_session

    session = local_session("tests", "4", **{"spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows and a schema text to a DataFrame."""
    return lambda data, schema: spark.createDataFrame(data, schema)
