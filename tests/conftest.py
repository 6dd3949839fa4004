import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from feedlens.session import local_session

    s = local_session("*", 8, "feedlens-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
