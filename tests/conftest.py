import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberlog.schemas import DETECTION_LOG  # noqa: E402
from emberlog.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "emberlog-tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def logs(spark):
    """Logs from (id, source, content, level, time) rows; the time may be text."""
    def build(*rows):
        fixed = [(i, s, c, lv, datetime.fromisoformat(t) if isinstance(t, str) else t)
                 for i, s, c, lv, t in rows]
        return spark.createDataFrame(fixed, DETECTION_LOG)
    return build
