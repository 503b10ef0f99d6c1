import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from clausegrid.session import build_session
    from clausegrid.streaming.jobs import STATE_CONF

    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", STATE_CONF[0]: STATE_CONF[1]})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
