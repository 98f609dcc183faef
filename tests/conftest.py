import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("panelmill-tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
