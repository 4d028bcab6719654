import pytest

from pagegate.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "pagegate-tests")
    yield s
    s.stop()


@pytest.fixture()
def out(tmp_path_factory):
    return str(tmp_path_factory.mktemp("spark-out"))
