import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lapcast.session import build_session

    session = build_session(4, 4, "lapcast-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(spark):
    """Send even small tables down the paths for over-full keys and large lookups."""
    spark.conf.set("lapcast.blockRows", "12")
    spark.conf.set("lapcast.broadcastRows", "3")
    yield
    spark.conf.unset("lapcast.blockRows")
    spark.conf.unset("lapcast.broadcastRows")


@pytest.fixture(scope="session")
def sf():
    return SF
