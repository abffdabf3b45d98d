"""One local session for all tests."""

import pytest

from detectlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    yield local_session(4, 4)
