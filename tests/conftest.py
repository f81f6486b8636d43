import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from sievelab.session import get_spark

    session = get_spark(8, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
