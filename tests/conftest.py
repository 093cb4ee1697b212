import pytest

from statuta.runtime import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session(8, partitions=2, memory="4g")
