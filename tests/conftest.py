import pytest

from tests import harness


@pytest.fixture(scope="session")
def spark():
    session = harness.session(cores="8", partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def con():
    return harness.connect(f"{harness.DATA}/sf0.001")
