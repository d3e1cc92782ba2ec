"""One local session for all tests."""

from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spanforge.session import session

    made = session("local[4]", 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")))
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
