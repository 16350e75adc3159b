import pytest

from tidelog.session import build_session
from tidelog.streaming.jobs import STATE_STORE


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "3", **STATE_STORE})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def work(tmp_path):
    return f"file://{tmp_path}/work"
