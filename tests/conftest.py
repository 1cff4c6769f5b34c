from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from meterline.session import local_session

    return local_session(8, memory="6g")


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def sql(sf):
    from compare import connect

    return connect(sf)
