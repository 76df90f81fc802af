import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from parchmint.session import local_session

    session = local_session(cores=8, shuffle=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
