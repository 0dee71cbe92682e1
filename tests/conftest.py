import pytest

from strataloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 4, 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
