import pytest

from civicgrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
