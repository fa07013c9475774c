import pytest

from presslake.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session
