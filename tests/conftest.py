import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from skein.session import local_session
    s = local_session(4, shuffle_partitions=4, app="skein-tests")
    yield s
    s.stop()
