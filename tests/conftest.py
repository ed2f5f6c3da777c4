import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from knotwork.session import local_session

    session = local_session(4, 2, "knotwork-tests")
    yield session
    session.stop()
