import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.session import findable, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = findable(session(4, spark__sql__shuffle__partitions="4"))
    yield s
    s.stop()
