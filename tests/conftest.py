"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from citytables.session import build_session

    folder = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "4", **{"spark.checkpoint.dir": f"file://{folder}", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
