import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

FILES = "project_id BIGINT, snapshot_id INT, path STRING, content STRING"


@pytest.fixture(scope="session")
def spark():
    from textmason.session import local_session

    session = local_session("8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Files table from {path: text}."""

    def build(texts: dict[str, str], project_id: int = 1, snapshot_id: int = 1):
        rows = [(project_id, snapshot_id, path, text) for path, text in texts.items()]
        return spark.createDataFrame(rows, FILES)

    return build
