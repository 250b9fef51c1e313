import pytest

from foliant.session import local_session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, "4g")
    if session.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    ship(session)
    yield session
    session.stop()
