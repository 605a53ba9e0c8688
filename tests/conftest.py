import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rigspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return f"{os.environ.get('RIGSPARK_TESTDATA', '/root/testdata')}/sf0.001"
