"""One local session for all tests."""

import pytest

from helixframe.session import session


@pytest.fixture(scope="session")
def spark():
    found = session("local[8]", shuffle_partitions=8, memory="4g")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
