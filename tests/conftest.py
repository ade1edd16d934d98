import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from garderobe.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", 4, 4, driver_memory="4g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
