import pytest

from tests.harness import session


@pytest.fixture(scope="session")
def spark():
    s = session(4)
    yield s
    s.stop()
